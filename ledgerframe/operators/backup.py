"""Backup sessions: classification, tree digests, inventories and cleanup plans.

Relations:
  sessions  session, is_link, is_dir, manifest (absent | unsafe | unbound | invalid | valid), state (open | complete |
            rolled-back | ...), manifest_sha256
  items     session, backup (path in the session), bytes, sha256
  entries   session, path, kind (file | dir | other), bytes, sha256
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.keys import path_key

#: Fixed values.
MANIFEST = "session-manifest.json"
CLASSES = ("managed", "interrupted-open-session", "missing-session-manifest", "invalid-session-manifest", "binding-unverifiable", "unexpected-entry", "legacy-unmanaged")
SESSION_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"
_FRAME = b"file\x00"


def expected_directories(items: DataFrame) -> DataFrame:
    return items.select("session", F.explode(paths.ancestors(F.col("backup"))).alias("path")).distinct()


def _expected(items: DataFrame, sessions: DataFrame) -> DataFrame:
    files = items.select("session", F.col("backup").alias("path")).union(sessions.select("session", F.lit(MANIFEST))).distinct().withColumn("kind", F.lit("file"))
    return files.unionByName(expected_directories(items).withColumn("kind", F.lit("dir")))


def classified(sessions: DataFrame, items: DataFrame, entries: DataFrame) -> DataFrame:
    """session, classification, state, planning_eligible, manifest_sha256, n_items, bytes; invalid ones have no items.

    The first rule that applies decides: the entry's name or kind, its manifest, its tree, its digests, its state."""
    want = _expected(items, sessions).withColumn("want", F.lit(1))
    have = entries.select("session", "path", "kind").withColumn("have", F.lit(1))
    tree = want.join(have, ["session", "path", "kind"], "full_outer").groupBy("session").agg(F.bool_and(F.col("want").isNotNull() & F.col("have").isNotNull()).alias("same_tree"))
    seen = entries.filter("kind = 'file'").select("session", F.col("path").alias("backup"), F.struct("bytes", "sha256").alias("disk"))
    sums = items.join(seen, ["session", "backup"], "left").groupBy("session").agg(
        F.bool_and(F.col("disk").eqNullSafe(F.struct("bytes", "sha256"))).alias("same_digests"), F.count("*").alias("n"), F.sum("bytes").alias("b")
    )
    rows = sessions.join(tree, "session", "left").join(sums, "session", "left")
    kind = (
        F.when(~F.col("session").rlike(SESSION_NAME) | F.col("is_link") | ~F.col("is_dir"), "unexpected-entry")
        .when(F.col("manifest") == "absent", "missing-session-manifest")
        .when(F.col("manifest") == "unbound", "binding-unverifiable")
        .when(F.col("manifest") != "valid", "invalid-session-manifest")
        .when(~F.coalesce("same_tree", F.lit(True)), "unexpected-entry")
        .when(~F.coalesce("same_digests", F.lit(True)), "invalid-session-manifest")
        .when(F.col("state") == "open", "interrupted-open-session")
        .otherwise("managed")
    )
    rows = rows.withColumn("classification", kind)
    sound = F.col("classification").isin("managed", "interrupted-open-session")
    return rows.select(
        safe_reference(F.col("session")).alias("session"),
        "classification",
        F.when(F.col("manifest") == "valid", F.col("state")).alias("state"),
        ((F.col("classification") == "managed") & (F.col("state") == "complete")).alias("planning_eligible"),
        F.when(sound, F.col("manifest_sha256")).alias("manifest_sha256"),
        F.when(sound, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_items"),
        F.when(sound, F.coalesce("b", F.lit(0))).otherwise(0).cast("long").alias("bytes"),
    )


def safe_reference(session: Column) -> Column:
    """The name of a session, or a digest in place of one that is not safe to print."""
    return F.when(session.rlike(SESSION_NAME), session).otherwise(F.concat(F.lit("invalid-session-"), F.sha2(session.cast("binary"), 256)))


def inventory_summary(inventory: DataFrame) -> DataFrame:
    """Counts by class, sums, and the exit code: 1 if anything is unhealthy or was not rolled back."""
    kind = F.col("classification")
    unhealthy = (kind != "managed") | F.coalesce(F.col("state") == "rollback-failed", F.lit(False))
    return inventory.agg(
        F.count("*").alias("sessions"), F.count_if(kind == "managed").alias("managed"), F.count_if(kind == "legacy-unmanaged").alias("legacy"),
        F.count_if(~kind.isin("managed", "legacy-unmanaged")).alias("orphaned"), F.count_if("planning_eligible").alias("planning_eligible"), F.sum("n_items").alias("items"), F.sum("bytes").alias("bytes"),
        F.when(F.coalesce(F.bool_or(unhealthy), F.lit(False)), 1).otherwise(0).alias("exit_code"),
    )


def tree_digests(entries: DataFrame) -> DataFrame:
    """session, tree_sha256: SHA-256 over the framed files of a session in key order.

    entries: session, path, content. The order is part of the digest, so a session's files are read by one task, one
    file at a time and sorted by Spark; sessions are many and spread."""
    keyed = entries.select("session", "path", path_key(F.col("path")).alias("key"), "content")
    dealt = keyed.repartition("session").sortWithinPartitions("session", "key", "path", "content").select("session", "path", "content")

    def run(batches):
        session, tree = None, None
        done: list[tuple[str, str]] = []

        def ended():
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], names=["session", "tree_sha256"])

        for batch in batches:
            for one, path, content in zip(*batch.columns, strict=True):
                if session != one.as_py() or tree is None:
                    if tree is not None:
                        done.append((session, tree.hexdigest()))
                    session, tree = one.as_py(), hashlib.sha256()
                name, data = path.as_py().encode(), content.as_py()
                tree.update(_FRAME + len(name).to_bytes(8, "big") + name + len(data).to_bytes(8, "big"))
                tree.update(data)
            yield ended()
            done.clear()
        if tree is not None:
            done.append((session, tree.hexdigest()))
            yield ended()

    return dealt.mapInArrow(run, "session string, tree_sha256 string")


def cleanup_plan(requested: DataFrame, inventory: DataFrame) -> DataFrame:
    """One action for each requested session (column session): eligible ones carry what they would delete."""
    known = inventory.withColumn("key", path_key(F.col("session"))).withColumnRenamed("session", "known")
    rows = requested.withColumn("key", path_key(F.col("session"))).join(known, "key", "left")
    fine = F.coalesce(F.col("planning_eligible") & (F.col("classification") == "managed") & (F.col("state") == "complete"), F.lit(False))
    number = lambda c: F.when(fine, F.col(c)).otherwise(0).cast("long")
    return rows.select(F.coalesce("known", "session").alias("session"), F.when(fine, F.col("manifest_sha256")).alias("manifest_sha256"), number("n_items").alias("files"), number("bytes").alias("bytes"), fine.alias("eligible"))


def cleanup_summary(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("requested"), F.count_if("eligible").alias("planned"), F.count_if(~F.col("eligible")).alias("blocked"))


def deletion_order(entries: DataFrame) -> DataFrame:
    """Deepest first, then by key: adds `step` from 1 within each session."""
    from pyspark.sql import Window

    order = Window.partitionBy("session").orderBy(paths.depth(F.col("path")).desc(), path_key(F.col("path")))
    return entries.withColumn("step", F.row_number().over(order))
