"""From issues to repair actions, approvals, preflight states and execution results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.keys import path_key

#: Fixed values.
REGENERATE_SIDECAR, REMOVE_STALE, REGENERATE_MANIFEST, MANUAL = "regenerate-sidecar", "remove-stale-sidecar", "regenerate-manifest", "manual-review"
DISTRUST = ("invalid-json", "invalid-schema", "unsupported-schema", "outside-package-root")
ROLLBACKS = {"succeeded": "available", "failed-precondition": "not-required", "failed": "not-required", "rolled-back": "completed", "rollback-failed": "failed", "not-run": "not-required"}


def manifest_trusted(issues: DataFrame, manifest_name: str | None) -> DataFrame:
    """One row: true unless an issue on the manifest itself says that it cannot be believed, or there is none."""
    bad = F.coalesce(F.bool_or((path_key(F.col("path")) == path_key(F.lit(manifest_name))) & F.col("category").isin(*DISTRUST)), F.lit(False))
    return issues.agg((F.lit(manifest_name is not None) & ~bad).alias("trusted"))


def plan(issues: DataFrame, manifest_name: str | None) -> DataFrame:
    """path, action, reason, safe: one action for each error; warnings make none."""
    believed = issues.crossJoin(F.broadcast(manifest_trusted(issues, manifest_name)))  # one row
    category, trusted = F.col("category"), F.col("trusted")
    action = F.when((category == "missing-sidecar") & trusted, REGENERATE_SIDECAR).when((category == "stale-sidecar") & trusted, REMOVE_STALE).when(category == "extra-artifact", REGENERATE_MANIFEST).otherwise(MANUAL)
    return believed.filter("severity <> 'warning'").select("path", action.alias("action"), category.alias("reason"), action.isin(REGENERATE_SIDECAR, REMOVE_STALE).alias("safe"))


def plan_summary(issues: DataFrame, actions: DataFrame) -> DataFrame:
    counts = actions.agg(F.count("*").alias("actions"), F.count_if(F.col("action") == MANUAL).alias("manual_review"))
    return issues.agg(F.count("*").alias("issues")).crossJoin(counts)


def approvable(actions: DataFrame) -> DataFrame:
    return actions.filter(F.col("safe") & (F.col("action") != MANUAL))


def preflight(approved: DataFrame, issues: DataFrame, items: DataFrame | None, files: DataFrame) -> DataFrame:
    """Readiness of each approved action against the present state, and the first reason that blocks it.

    files also names the sidecars on disk. items is None if the manifest cannot be read."""
    there = F.struct(F.lit(True).alias("exists"), "bytes", "sha256")
    absent = F.struct(F.lit(False).alias("exists"), F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("string").alias("sha256"))
    rows = approved.join(files.select("path", there.alias("found")), "path", "left").withColumn("target", F.coalesce("found", absent)).drop("found")
    if items is None:
        rows = rows.withColumns({"n": F.lit(0), "current": F.lit(False), "fine": F.lit(False)})
    else:
        disk = files.select(F.col("path").alias("output_path"), F.struct("bytes", "sha256").alias("disk"))
        own = items.join(disk, "output_path", "left").select(path_key(paths.sidecar_of(F.col("output_path"))).alias("key"), F.struct("status", "input", "output", "disk").alias("item"))
        now = issues.select(path_key(F.col("path")).alias("key"), F.col("category").alias("reason"))
        # items and present issues of a key as one row: both are narrow, and are dealt out once
        facts = own.select("key", "item", F.lit(None).cast("string").alias("reason")).unionByName(now.select("key", F.lit(None).cast(own.schema["item"].dataType).alias("item"), "reason"))
        facts = facts.groupBy("key").agg(F.count("item").alias("n"), F.first("item", ignorenulls=True).alias("item"), F.collect_set("reason").alias("reasons"))  # a handful of categories
        rows = rows.withColumn("key", path_key(F.col("path"))).join(facts, "key", "left")
        i = F.col("item")
        intact = i["status"].isin("succeeded", "skipped") & i["input"]["sha256"].isNotNull() & i["input"]["bytes"].isNotNull() & ~F.col("target.exists") & i["disk"].isNotNull() & (i["disk"] == i["output"])
        stale = (i["status"] == "failed") & F.col("target.exists") & F.col("target.sha256").isNotNull()
        rows = rows.withColumns({"current": F.array_contains("reasons", F.col("reason")), "fine": F.when(F.col("action") == REGENERATE_SIDECAR, intact).otherwise(stale)})
    supported = F.col("action").isin(REGENERATE_SIDECAR, REMOVE_STALE)
    ready = supported & paths.is_safe(F.col("path")) & F.coalesce((F.col("n") == 1) & F.col("current") & F.col("fine"), F.lit(False))
    reason = F.when(ready, None).when(~supported, "unsupported-action").when(F.lit(items is None), "manifest-invalid").when(~paths.is_safe(F.col("path")), "path-unsafe").otherwise("package-state-changed")
    return rows.select("path", "action", "reason", F.when(ready, "ready").otherwise("blocked").alias("status"), reason.alias("block_reason"), (F.col("action") == REMOVE_STALE).alias("backup_required"), "target")


def preflight_summary(rows: DataFrame) -> DataFrame:
    ready = F.count_if(F.col("status") == "ready")
    return rows.agg(F.count("*").alias("actions"), ready.alias("ready"), (F.count("*") - ready).alias("blocked"), F.when(F.count("*") > ready, 1).otherwise(0).alias("exit_code"))


def execution_summary(rows: DataFrame) -> DataFrame:
    failed = F.col("status").isin("failed-precondition", "failed", "rollback-failed")
    return rows.agg(F.count("*").alias("actions"), F.count_if(F.col("status") != "not-run").alias("executed"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(failed).alias("failed"), F.count_if(F.col("status") == "rolled-back").alias("rolled_back"))


def fail_fast(actions: DataFrame, group: list[str], order: str, failed: Column) -> DataFrame:
    """Statuses of actions run one after another: after the first failure of a group nothing runs. Adds
    `outcome` and, for the whole group, `first_failure` (null if there is none)."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    bad = failed.cast("int")
    stopped = F.coalesce(F.max(bad).over(before), F.lit(0)) == 1
    outcome = F.when(stopped, "not-run").when(failed, "failed").otherwise("done")
    return actions.withColumn("first_failure", F.min(F.when(failed, F.col(order))).over(whole)).withColumn("outcome", outcome)
