"""Registered queries over decisions drawn from reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import audit, backup, convert, ledger, repair
from . import ledger_queries as L
from .synth import read

def execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.execution_summary(L._repair_reports(spark, sf_dir).select(F.explode("actions").alias("a")).select("a.status"))


def cleanup_plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backup.cleanup_summary(L.cleanup_plan(spark, sf_dir))


def deletion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backup.deletion_order(L._backup(spark, sf_dir)[2]).select("session", "path", "step")


def expected_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.sidecar_rows(L._ledger(spark, sf_dir)[0], L._engine(), L._settings(F.lit(False)))
    return rows.select("sidecar_path", "input_path", "output_path", "status", F.col("source.sha256").alias("source_sha256"), F.col("artifact.bytes").alias("artifact_bytes"), F.col("engine.name").alias("engine"), F.col("settings.normalization_profile").alias("profile"))


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items, _, files = L._ledger(spark, sf_dir)
    return items.select("input_path", paths.with_suffix(F.col("input_path"), ".md").alias("output_path")), files.filter("bytes > 1000")


def pending_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, there = _requests(spark, sf_dir)
    state = lambda rows, name: rows.select("input_path", "output_path", F.lit(name).alias("state"))
    return state(convert.pending(requests, there), "pending").unionByName(state(convert.already_there(requests, there), "skipped"))


def undeclared_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of orders that are no declared source: every ninth. They are counted where they are, and the sources of
    these counts are looked up; by a merge, as Spark takes digests for as narrow as the keys they are made of."""
    k = F.col("l_orderkey")
    sources = L._repair_reports(spark, sf_dir).filter(k % 9 != 0).select(F.lit(audit.REPAIR).alias("source_type"), "sha256")
    counted = audit.repair_operations(L._repair_reports(spark, sf_dir)).groupBy("source_type", "sha256").agg(F.count("*").alias("operations"))
    return audit.undeclared(counted, sources.hint("merge")).select("sha256", "operations")


def canonical_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the lines of an order come in the order of part and supplier."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"), F.max("l_suppkey").alias("supplier"))
    return audit.in_canonical_order(rows, ["l_orderkey"], "l_linenumber", "part", "supplier")


def context_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.context_summary(audit.repair_operations(L._repair_reports(spark, sf_dir)), L.intent_pairing(spark, sf_dir).select(F.col("operator_required")))


def mode_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of event what its cases recommend; events without a failure recommend nothing new."""
    e = F.col("event_id")
    out = None
    for name, passed in (("mixed", e % 3 != 0), ("better", (e % 2 == 1) | (e % 5 != 0)), ("same", F.lit(True))):
        rows = read(spark, sf_dir, "events").select(F.floor(e / 2).alias("case"), F.when(e % 2 == 0, "baseline").otherwise("table").alias("mode"), passed.alias("passed"), F.round(e % 100 / 10, 3).alias("seconds"))
        one = audit.recommendation(audit.compared_modes(rows)).withColumn("set", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    f.__name__: f
    for f in (execution_summary, cleanup_plan_summary, deletion_order, expected_sidecars, pending_requests, undeclared_operations, canonical_order_check, context_totals, mode_recommendation)
}

_MODES = " UNION ALL ".join(
    f"SELECT '{name}' AS s, a.event_id // 2 AS k, {ok.format('a.event_id')} AS x, {ok.format('b.event_id')} AS y FROM events a JOIN events b ON a.event_id % 2 = 0 AND b.event_id = a.event_id + 1"
    for name, ok in (("mixed", "{0} % 3 <> 0"), ("better", "({0} % 2 = 1 OR {0} % 5 <> 0)"), ("same", "true OR {0} = 0"))
)
ORACLES = {
    "execution_summary": f"WITH {L._OPS} SELECT count(*) AS actions, count(*) AS executed, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status IN ('failed', 'failed-precondition', 'rollback-failed')) AS failed, count(*) FILTER (status = 'rolled-back') AS rolled_back FROM o0",
    "cleanup_plan_summary": f"WITH {L._BACKUP} SELECT count(*) AS requested, count(*) FILTER (coalesce(planning_eligible, false)) AS planned, count(*) FILTER (NOT coalesce(planning_eligible, false)) AS blocked FROM (SELECT 'session-' || (s_suppkey + CASE WHEN s_suppkey % 10 = 0 THEN 100000 ELSE 0 END) AS q FROM supplier) LEFT JOIN inv ON inv.session = q",
    "deletion_order": f"WITH {L._BACKUP}, e AS (SELECT session, backup AS path FROM i WHERE p % 101 <> 0 UNION ALL SELECT * FROM (SELECT session, 'package' FROM i UNION SELECT session, 'package/' || (p % 3) FROM i) UNION ALL SELECT session, 'session-manifest.json' FROM s) SELECT session, path, row_number() OVER (PARTITION BY session ORDER BY length(path) - length(replace(path, '/', '')) DESC, path) AS step FROM e",
    "expected_sidecars": f"WITH {L._LEDGER} SELECT ex AS sidecar_path, ip AS input_path, op AS output_path, status, ish AS source_sha256, ob AS artifact_bytes, 'ledgerframe' AS engine, 'conservative' AS profile FROM it WHERE status <> 'failed'",
    "pending_requests": f"WITH {L._LEDGER} SELECT ip AS input_path, op AS output_path, CASE WHEN op IN (SELECT path FROM fl WHERE ob > 1000) THEN 'skipped' ELSE 'pending' END AS state FROM it",
    "undeclared_operations": "SELECT sha256(l_orderkey::VARCHAR) AS sha256, count(*) AS operations FROM lineitem WHERE l_orderkey % 9 = 0 GROUP BY l_orderkey",
    "canonical_order_check": "WITH l AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY 1, 2), w AS (SELECT *, lag(a) OVER x AS pa, lag(b) OVER x AS pb FROM l WINDOW x AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) SELECT l_orderkey, bool_and(pa IS NULL OR pa < a OR (pa = a AND pb < b)) AS canonical FROM w GROUP BY 1",
    "context_totals": f"WITH {L._OPS}, {L._PAIR}, q AS (SELECT bool_or(classification <> 'paired' OR life IS NOT NULL) AS r, count(*) AS n FROM y) SELECT (SELECT count(*) FROM ro) AS operations, (SELECT count(*) FROM ro WHERE outcome <> 'succeeded') AS required_operations, n AS statuses, r OR (SELECT count(*) FROM ro WHERE outcome <> 'succeeded') > 0 AS required FROM q",
    "mode_recommendation": f"WITH m AS ({_MODES}) SELECT s AS \"set\", CASE WHEN bool_or(x AND NOT y) THEN 'keep-baseline' WHEN bool_or(y AND NOT x) THEN 'optional-table-mode' ELSE 'keep-baseline' END AS recommendation, count(*) FILTER (x AND NOT y) AS regressed, count(*) FILTER (y AND NOT x) AS improved FROM m GROUP BY s",
}
