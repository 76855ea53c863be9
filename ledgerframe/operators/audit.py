"""Audits over execution reports: operation facts, summaries, verification of sources, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
REPAIR, CLEANUP = "repair-execution", "backup-cleanup-audit"
OUTCOMES = ("succeeded", "failed", "partial", "rolled_back", "not_run")
_STATE = "struct<exists:boolean,bytes:bigint,sha256:string>"


def package_change(before: Column, after: Column) -> Column:
    """Whether a target changed: unknown unless both states are absent or fully digested."""
    told = lambda s: ~s["exists"] | (s["bytes"].isNotNull() & s["sha256"].isNotNull())
    return F.when(~(told(before) & told(after)), "unknown").when(before.eqNullSafe(after), "unchanged").otherwise("changed")


def repair_operations(reports: DataFrame) -> DataFrame:
    """reports: sha256, actions array<struct<action,path,status,rollback,before,after>>; one fact for each action."""
    rows = reports.select("sha256", F.posexplode("actions").alias("action_index", "a"))
    change = package_change(F.col("a.before"), F.col("a.after"))
    return repair_facts(rows.select("sha256", "action_index", F.col("a.action").alias("action"), F.col("a.path").alias("path"), F.col("a.status").alias("status"), F.col("a.rollback").alias("rollback"), change.alias("package_change")))


def repair_facts(rows: DataFrame) -> DataFrame:
    status, change = F.col("status"), F.col("package_change")
    outcome = F.when(status == "succeeded", "succeeded").when(status == "rolled-back", "rolled_back").when(status == "rollback-failed", "partial").when(status == "not-run", "not_run").when(status == "failed-precondition", "failed").when(change == "changed", "partial").otherwise("failed")
    reason = F.when(status == "succeeded", "completed").when(status.isin("rolled-back", "rollback-failed", "not-run"), status).when(status == "failed-precondition", "precondition-failed").when(change == "unknown", "source-failure-mutation-unknown").otherwise("execution-failed")
    return rows.select(F.lit(REPAIR).alias("source_type"), "sha256", "action_index", F.concat(F.lit("repair-"), F.col("action")).alias("operation"), F.col("path").alias("target"), F.lit("package").alias("scope"), "status", outcome.alias("outcome"), "rollback", "package_change", (outcome != "succeeded").alias("operator_required"), reason.alias("reason"))


def cleanup_operations(reports: DataFrame) -> DataFrame:
    """reports: sha256, actions array<struct<session,status>>."""
    return cleanup_facts(reports.select("sha256", F.posexplode("actions").alias("action_index", "a")).select("sha256", "action_index", F.col("a.session").alias("session"), F.col("a.status").alias("status")))


def cleanup_facts(rows: DataFrame) -> DataFrame:
    status = F.col("status")
    outcome = F.when(status == "deleted", "succeeded").when(status == "failed", "failed").otherwise("not_run")
    reason = F.when(status == "deleted", "completed").when(status == "failed", "cleanup-failed").otherwise("not-run")
    return rows.select(F.lit(CLEANUP).alias("source_type"), "sha256", "action_index", F.lit("backup-delete-session").alias("operation"), F.col("session").alias("target"), F.lit("backup").alias("scope"), "status", outcome.alias("outcome"), F.lit(None).cast("string").alias("rollback"), F.lit("unknown").alias("package_change"), (outcome != "succeeded").alias("operator_required"), reason.alias("reason"))


def any_change(change: Column) -> Column:
    """Three-valued: true if anything changed, false if all (and something) stayed, else null."""
    return F.when(F.bool_or(change == "changed"), True).when(F.bool_and(change == "unchanged"), False)


def summary(operations: DataFrame, *by: str) -> DataFrame:
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return operations.groupBy(*by).agg(F.count("*").alias("operations"), *counts, F.count_if("operator_required").alias("operator_required"), any_change(F.col("package_change")).alias("package_changed"))


def multiset(expected: DataFrame, provided: DataFrame, *by: str) -> DataFrame:
    """matched, missing and unexpected rows (columns source_type, sha256) counted with their repeats."""
    key = [*by, "source_type", "sha256"]
    a = expected.groupBy(*key).agg(F.count("*").alias("e"))
    b = provided.groupBy(*key).agg(F.count("*").alias("p"))
    e, p = F.coalesce("e", F.lit(0)), F.coalesce("p", F.lit(0))
    both = a.join(b, key, "full_outer")
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)
    return both.groupBy(*by).agg(total(F.least(e, p), "matched"), total(F.greatest(e - p, F.lit(0)), "missing"), total(F.greatest(p - e, F.lit(0)), "unexpected"))


def verification_exit(valid: Column, missing: Column, unexpected: Column) -> Column:
    return F.when(~valid, 2).when((missing > 0) | (unexpected > 0), 1).otherwise(0)


def contiguous(rows: DataFrame, source: list[str], index: str) -> DataFrame:
    """Whether the indexes of each source run from 0 without gaps or repeats."""
    place = F.row_number().over(Window.partitionBy(*source).orderBy(index)) - 1
    return rows.withColumn("__fits", place == F.col(index)).groupBy(*source).agg(F.bool_and("__fits").alias("contiguous"), F.count("*").alias("n"))


def in_canonical_order(rows: DataFrame, source: list[str], seq: str, *key: str) -> DataFrame:
    """Whether the rows of each source, by seq, are sorted by key without repeats."""
    own = F.struct(*key)
    before = F.lag(own).over(Window.partitionBy(*source).orderBy(seq))
    return rows.withColumn("__fits", before.isNull() | (before < own)).groupBy(*source).agg(F.bool_and("__fits").alias("canonical"))


def undeclared(operations: DataFrame, sources: DataFrame) -> DataFrame:
    """Operations whose source the audit does not declare."""
    return operations.join(sources, ["source_type", "sha256"], "left_anti")


def context_summary(operations: DataFrame, statuses: DataFrame) -> DataFrame:
    """required: any operation or any intent status asks for an operator."""
    ops = operations.agg(F.count("*").alias("operations"), F.count_if("operator_required").alias("required_operations"))
    sts = statuses.agg(F.count("*").alias("statuses"), F.coalesce(F.bool_or("operator_required"), F.lit(False)).alias("any_status"))
    return ops.crossJoin(sts).select("operations", "required_operations", "statuses", ((F.col("required_operations") > 0) | F.col("any_status")).alias("required"))  # two rows of one


def context_verified(expected: DataFrame, provided: DataFrame, *by: str) -> DataFrame:
    """Projections by digest, expected against provided: all there, none else, all equal (columns sha256, projection)."""
    a, b = expected.withColumnRenamed("projection", "e"), provided.withColumnRenamed("projection", "p")
    both = a.join(b, [*by, "sha256"], "full_outer")
    return both.groupBy(*by).agg(
        F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"), F.count_if(F.col("e") != F.col("p")).alias("different"), F.bool_and(F.col("e").eqNullSafe(F.col("p"))).alias("verified")
    )


def compared_modes(results: DataFrame) -> DataFrame:
    """results: case, mode (baseline | table), passed, seconds; one row a case, and whether it regressed or improved."""
    by = results.groupBy("case").pivot("mode", ["baseline", "table"]).agg(F.first("passed").alias("passed"), F.first("seconds").alias("seconds"))
    a, b = F.col("baseline_passed"), F.col("table_passed")
    return by.select("case", a, b, F.col("baseline_seconds"), F.col("table_seconds"), F.round(F.col("table_seconds") - F.col("baseline_seconds"), 3).alias("delta"), (a & ~b).alias("regressed"), (~a & b).alias("improved"))


def recommendation(compared: DataFrame) -> DataFrame:
    bad, good = F.bool_or("regressed"), F.bool_or("improved")
    return compared.agg(F.when(bad, "keep-baseline").when(good, "optional-table-mode").otherwise("keep-baseline").alias("recommendation"), F.count_if("regressed").alias("regressed"), F.count_if("improved").alias("improved"))
