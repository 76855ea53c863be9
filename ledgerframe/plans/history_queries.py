"""Registered queries over histories and chains of bindings, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import histories
from .synth import read


def session_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of sessions: a user's events of an hour are one, their values tell the state."""
    e = read(spark, sf_dir, "events")
    v = F.floor(F.col("value") * 100).cast("long")
    state = F.when(v % 5 < 3, "open").when(v % 7 == 0, "rolled-back").when(v % 11 == 0, "rollback-failed").when(v % 13 == 0, F.lit(None)).otherwise("complete")
    steps = e.select("user_id", F.floor(F.col("event_id") / 1000).alias("part"), "event_id", state.alias("state"))
    return histories.first_illegal(steps, ["user_id", "part"], ["event_id"])


def _bindings(**named: Column) -> Column:
    return F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in named.items())), lambda e: e["value"].isNotNull()))


def package_reports(orders: DataFrame) -> DataFrame:
    """Orders as receipts with the reports that they lead to, a customer's orders as a package: some reports are not there,
    some twice, some bound to other plans or manifests."""
    k, package = F.col("o_orderkey"), F.col("o_custkey").alias("package")
    sha = lambda kind, number=k: F.sha2(F.concat(F.lit(f"{kind} "), number.cast("string")).cast("binary"), 256)
    other = lambda by, kind: F.when(k % by == 0, sha(kind, k + 1)).otherwise(sha(kind))
    named = {
        "receipt": _bindings(preflight=sha("preflight"), approval=sha("approval"), plan=sha("plan"), manifest=sha("manifest")),
        "preflight": _bindings(approval=other(17, "approval"), plan=sha("plan"), manifest=sha("manifest")),
        "approval": _bindings(plan=other(19, "plan"), manifest=sha("manifest")),
        "plan": _bindings(manifest=F.when(k % 23 != 0, sha("manifest"))),
        "manifest": F.create_map().cast("map<string,string>"),
    }
    there = {"receipt": F.lit(1), "preflight": F.when(k % 7 == 0, 0).otherwise(1), "approval": F.when(k % 11 == 0, 2).otherwise(1), "plan": F.when(k % 13 == 0, 0).otherwise(1), "manifest": F.when(k % 29 == 0, 0).when(k % 31 == 0, 2).otherwise(1)}
    every = F.array(*(F.struct(F.lit(kind).alias("kind"), sha(kind).alias("sha256"), named[kind].alias("bindings"), n.alias("n")) for kind, n in there.items()))
    rows = orders.select(package, F.explode(every).alias("r"))
    return rows.select("package", "r.kind", "r.sha256", "r.bindings", F.explode(F.array_repeat(F.lit(1), F.col("r.n"))).alias("copy")).drop("copy")


def binding_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histories.chains(package_reports(read(spark, sf_dir, "orders")))


QUERIES = {f.__name__: f for f in (session_histories, binding_chains)}
ORACLES = {
    "session_histories": """WITH e AS (SELECT user_id, event_id // 1000 AS part, event_id, floor(value * 100)::BIGINT AS v FROM events),
s AS (SELECT user_id, part, event_id, CASE WHEN v % 5 < 3 THEN 'open' WHEN v % 7 = 0 THEN 'rolled-back' WHEN v % 11 = 0 THEN 'rollback-failed' WHEN v % 13 = 0 THEN NULL ELSE 'complete' END AS state FROM e),
l AS (SELECT *, lag(state) OVER w AS before, row_number() OVER w - 1 AS place FROM s WINDOW w AS (PARTITION BY user_id, part ORDER BY event_id)),
f AS (SELECT *, CASE WHEN place = 0 THEN coalesce(state = 'open', false) ELSE coalesce(before = 'open', false) AND state IS NOT NULL END AS legal FROM l),
b AS (SELECT user_id, part, min(place) AS place FROM f WHERE NOT legal GROUP BY ALL),
a AS (SELECT user_id, part, count(*) AS steps, count(*) FILTER (NOT legal) AS illegal, max(place) AS m FROM f GROUP BY ALL)
SELECT a.user_id, a.part, steps, z.state AS last_state, illegal, b.place::INTEGER AS place, x.before, x.state FROM a JOIN f z ON z.user_id = a.user_id AND z.part = a.part AND z.place = a.m
  LEFT JOIN b ON b.user_id = a.user_id AND b.part = a.part LEFT JOIN f x ON x.user_id = b.user_id AND x.part = b.part AND x.place = b.place""",
    "binding_chains": """WITH k AS (SELECT o_custkey AS package, o_orderkey AS k FROM orders),
r AS (SELECT package, sha256('receipt ' || k) AS receipt, CASE WHEN k % 7 = 0 THEN 1 WHEN k % 17 = 0 THEN 2 WHEN k % 11 = 0 THEN 3 WHEN k % 19 = 0 THEN 4 WHEN k % 13 = 0 THEN 5 WHEN k % 23 = 0 THEN 6 WHEN k % 29 = 0 THEN 7 WHEN k % 31 = 0 THEN 8 ELSE 9 END AS c FROM k)
SELECT package, receipt, ['receipt', 'receipt', 'preflight', 'preflight', 'approval', 'approval', 'plan', 'plan', 'manifest'][c] AS reached,
  ['preflight: missing', 'preflight: mismatch', 'approval: several', 'approval: mismatch', 'plan: missing', 'plan: mismatch', 'manifest: missing', 'manifest: several', NULL][c] AS broken FROM r""",
}
