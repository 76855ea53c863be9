"""Registered queries that read sidecars, manifests and reports written from the tables, and their SQL.

Every document is written as a sidecar and as a line of a manifest, every order as a report of one of five families, with
faults by its ids and, where a text becomes part of a path or a version, by what the text holds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import convert, ledger, readers
from .synth import read

PRODUCER = "ledgerframe"


def _struct(**fields: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _sha(value: Column) -> Column:
    return F.sha2(value.cast("string").cast("binary"), 256)


def _faulty(number: Column, value: Column, **faults: Column) -> Column:
    """value, or what stands in its place where the number is divisible: _faulty(i, x, by_5=y)."""
    for by, other in faults.items():
        value = F.when(number % int(by.removeprefix("by_")) == 0, other).otherwise(value)
    return value


def sidecar_texts(documents: DataFrame) -> DataFrame:
    """path and content: a sidecar for each document. Its input path begins with the text's first 30 characters, its
    engine's version is the first one."""
    i = F.col("doc_id")
    document = _struct(input_path=F.concat(F.left("text", F.lit(30)), F.lit(".pdf")), output_path=_faulty(i, F.concat_ws("/", "source", i.cast("string")), by_29=F.lit("../up.md"), by_83=F.lit("")), status=_faulty(i, F.lit("succeeded"), by_31=F.lit("failed"), by_3=F.lit("skipped")))
    digest = ledger.digest(F.col("text"))
    artifact = _faulty(i, F.to_json(_struct(bytes=digest["bytes"], sha256=_faulty(i, digest["sha256"], by_37=F.upper(digest["sha256"])))), by_41=F.lit('{"bytes":true,"sha256":"' + "0" * 64 + '"}'), by_43=F.lit("[]"), by_47=F.concat(F.lit('{"bytes":10.0,"sha256":"'), digest["sha256"], F.lit('"}')))
    source = _struct(bytes=F.length("text").cast("long"), sha256=_sha(i))
    settings = _faulty(i, F.lit('{"table_structure":true,"normalization_profile":null,"artifacts_path_configured":false}'), by_53=F.lit('{"table_structure":"yes","artifacts_path_configured":false}'), by_2=F.lit('{"table_structure":false,"normalization_profile":"none","artifacts_path_configured":true}'))
    version = _faulty(i, F.lit("1"), by_7=F.lit("1.0"), by_11=F.lit("true"), by_59=F.lit("2"), by_61=F.lit('"1"'))
    kind = _faulty(i, F.lit(readers.SIDECAR_TYPE), by_67=F.lit("other"))
    whole = F.concat(
        F.lit('{"schema_version": '), version, F.lit(', "report_type": "'), kind, F.lit('", "engine": '), F.to_json(_struct(name=F.lit(PRODUCER), version=F.left("text", F.lit(1)))), F.lit(', "document": '), F.to_json(document),
        F.lit(', "artifact": '), artifact, F.lit(', "source": '), F.to_json(source), F.lit(', "settings": '), settings, F.lit(', "more": [1, {"x": null}]}'),
    )
    content = _faulty(i, whole, by_71=F.concat(F.lit("["), whole, F.lit("]")), by_73=F.left(whole, F.length(whole) - 1), by_79=F.concat(whole, F.lit(" {}")))
    return documents.select(i.cast("string").alias("path"), content.alias("content"))


def sidecar_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.sidecars(sidecar_texts(read(spark, sf_dir, "documents")), PRODUCER)
    return found.select("path", "category", "output_path", "status", F.col("artifact.bytes").alias("artifact_bytes"), F.col("artifact.sha256").alias("artifact_sha256"), F.col("settings.table_structure").alias("table_structure"), F.col("settings.normalization_profile").alias("profile"))


def manifest_texts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and lines: the documents of a source, a language and one of 300 numbers are a manifest. A line's input path
    begins with the text's first 30 characters."""
    i = F.col("doc_id")
    key = F.concat_ws("/", "source", "lang", (i % 300).cast("string"))
    failed = i % 9 == 0
    d = ledger.digest(F.col("text"))
    there = _struct(path=F.concat(F.left("text", F.lit(30)), F.lit(".pdf")), bytes=d["bytes"], sha256=_sha(i))
    made = _struct(path=_faulty(i, F.concat_ws("/", "source", i.cast("string")), by_23=F.lit("C:/x.md"), by_91=F.lit("a/../../b")), bytes=F.when(~failed | (i % 2 == 0), d["bytes"] - F.when(i % 31 == 0, d["bytes"] + 1).otherwise(0)), sha256=F.when(~failed & (i % 37 != 0), d["sha256"]))
    line = F.to_json(_struct(input=there, output=made, status=F.when(failed, "failed").when(i % 41 == 0, "lost").otherwise("succeeded")))
    lines = documents.select(key.alias("manifest"), i.alias("seq"), _faulty(i, line, by_43=F.lit("7"), by_47=F.concat(line, F.lit("}"))).alias("content"))
    n = F.col("k")
    head = lambda version, engine, settings: F.concat(F.lit('{"schema_version":'), version, F.lit(f',"report_type":"{readers.MANIFEST_TYPE}","engine":{{"name":"'), engine, F.lit('","version":""},"settings":'), settings, F.lit("}"))
    sound = F.lit('{"table_structure":true,"artifacts_path_configured":false}')
    content = head(_faulty(n, F.lit("1"), by_13=F.lit("3"), by_17=F.lit("1e0")), _faulty(n, F.lit(PRODUCER), by_19=F.lit("someone")), _faulty(n, sound, by_29=F.lit('{"table_structure":true,"normalization_profile":0,"artifacts_path_configured":false}')))
    heads = documents.select(key.alias("manifest"), (i % 300).alias("k")).distinct().select("manifest", _faulty(n, content, by_31=F.lit("not json"), by_37=F.lit("null")).alias("content"))
    return heads, lines


def manifest_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, items = readers.manifests(*manifest_texts(read(spark, sf_dir, "documents").filter("source is not null and lang is not null")), PRODUCER)
    sums = items.groupBy("manifest").agg(F.sum("output.bytes").alias("output_bytes"), F.count_if(F.col("status") == "failed").alias("failed"))
    return found.join(sums, "manifest", "left")


def report_texts(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """report, family and content: orders as reports of five families by their numbers, their lines as actions."""
    o, n, q = F.col("o_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    makes = n % 3 == 0
    own = _struct(
        path=F.concat(F.lit("p/"), n.cast("string"), F.lit("/"), q.cast("string"), F.lit(".metadata.json")), kind=F.when(makes, "regenerate-sidecar").when(n % 3 == 1, "remove-stale-sidecar").otherwise("manual-review"),
        why=F.when(makes, "missing-sidecar").when(n % 3 == 1, "stale-sidecar").otherwise("path-mismatch"), n=n.cast("long"), q=q.cast("long"), flag=F.col("l_returnflag"),
    )
    acts = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(n.alias("i"), own.alias("a")))).alias("l"))  # an order's lines: a handful
    rows = orders.join(acts, "o_orderkey").select("o_orderkey", F.floor(o / 5).alias("k"), (o % 5).alias("f"), F.transform("l", lambda x: x["a"]).alias("a"))
    k, a = F.col("k"), F.col("a")
    sha, none = _sha(o), F.lit(None).cast("string")
    wrong = lambda by, count: count + F.when(k % by == 0, 1).otherwise(0)
    size = lambda c: F.size(c).cast("long")
    repairs = F.filter(a, lambda x: x["kind"] != "manual-review")
    planned = lambda rows: F.transform(rows, lambda x: _struct(path=F.when((k % 7 == 0) & (x["n"] == 1), "../x").otherwise(x["path"]), action=x["kind"], reason_category=x["why"], safe=(x["kind"] != "manual-review") != ((k % 11 == 0) & (x["n"] == 2))))
    nothing = _struct(exists=F.lit(False), bytes=F.lit(None).cast("long"), sha256=none)
    thing = lambda x: _struct(exists=F.lit(True), bytes=x["q"], sha256=F.when((k % 13 == 0) & (x["n"] == 1), none).otherwise(_sha(x["q"])))
    ready = lambda x: x["flag"] != "R"
    checked = F.transform(repairs, lambda x: _struct(
        path=x["path"], action=x["kind"], reason_category=x["why"], status=F.when(ready(x), "ready").otherwise("blocked"), block_reason=F.when(~ready(x), "package-state-changed"),
        preconditions=_struct(plan_approved=F.lit(True), safe=k % 17 != 0, package_state_matches=ready(x), backup_required=x["kind"] == "remove-stale-sidecar"),
        target=_struct(path=x["path"], exists=x["kind"] == "remove-stale-sidecar", bytes=F.when(x["kind"] == "remove-stale-sidecar", x["q"]), sha256=F.when((x["kind"] == "remove-stale-sidecar") & ~((k % 13 == 0) & (x["n"] == 1)), _sha(x["q"]))),
    ))
    status = lambda x: F.when(x["flag"] == "A", "succeeded").when(x["flag"] == "R", "failed").otherwise("not-run")
    done = F.transform(repairs, lambda x: _struct(
        path=F.when((k % 11 == 0) & (x["n"] == 3), F.concat(F.lit("A/"), x["path"])).otherwise(x["path"]), action=x["kind"], status=status(x),
        before=F.when((x["kind"] == "regenerate-sidecar") | (status(x) != "succeeded"), nothing).otherwise(thing(x)), after=F.when((x["kind"] == "regenerate-sidecar") & (status(x) == "succeeded"), thing(x)).otherwise(nothing), rollback=F.when(status(x) == "succeeded", "available").otherwise("not-required"),
    ))
    n_of = lambda flags: size(F.filter(repairs, lambda x: x["flag"].isin(*flags)))
    cleaned = F.transform(a, lambda x: _struct(session=F.concat(F.lit("s-"), x["n"].cast("string")), status=F.when(x["flag"] == "A", "deleted").when(x["flag"] == "R", "failed").otherwise("not-run"), before=_struct(files=x["n"], bytes=x["q"], tree_sha256=_sha(x["q"])), after=_struct(exists=(x["flag"] != "A") | ((k % 13 == 0) & (x["n"] == 1)))))
    every = lambda flags: size(F.filter(a, lambda x: x["flag"].isin(*flags)))
    bound = _struct(sha256=F.when(k % 19 == 0, F.lit("none")).otherwise(sha))
    version = F.when(k % 23 == 0, 2).otherwise(1)
    kind = lambda family: F.when(k % 29 == 0, "other").otherwise(readers.report_type(family, PRODUCER))
    to = lambda family, **body: F.to_json(_struct(report_type=kind(family), schema_version=version, **body), {"ignoreNullFields": "false"})
    manual = size(F.filter(a, lambda x: x["kind"] == "manual-review"))
    content = (
        F.when(F.col("f") == 0, to("plan", summary=_struct(issues=wrong(31, size(a) - 1), actions=size(a), manual_review=wrong(37, manual)), actions=planned(a)))
        .when(F.col("f") == 1, to("approval", plan=_struct(sha256=sha, schema_version=F.lit(1.0)), scope=_struct(mode=_faulty(k, F.lit("all-safe"), by_31=F.lit("some"))), approved_actions=planned(F.when(k % 37 == 0, a).otherwise(repairs))))
        .when(F.col("f") == 2, to("preflight", summary=_struct(actions=size(repairs), ready=wrong(31, n_of("AN")), blocked=n_of("R")), plan=bound, approval=bound, actions=checked))
        .when(F.col("f") == 3, to("execution", summary=_struct(planned=size(repairs), executed=n_of("AR"), succeeded=n_of("A"), failed=wrong(31, n_of("R")), rolled_back=F.lit(0), not_run=n_of("N")), plan=bound, approval=bound, preflight=bound, post_validation=F.lit("passed"), actions=done))
        .otherwise(to("cleanup-audit", bindings=_struct(inventory_sha256=bound["sha256"], plan_sha256=sha, approval_sha256=sha), summary=_struct(planned=size(a), deleted=every("A"), failed=wrong(31, every("R")), not_run=every("N")), actions=cleaned))
    )
    family = F.element_at(F.array(*map(F.lit, ("plan", "approval", "preflight", "execution", "cleanup-audit"))), (F.col("f") + 1).cast("int"))
    return rows.select(F.col("o_orderkey").alias("report"), _faulty(k, family, by_41=F.lit("letter")).alias("family"), _faulty(k, content, by_43=F.concat(content, F.lit("]"))).alias("content"))


def report_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_returnflag").alias("l_returnflag"))  # numbers can repeat
    return readers.reports(report_texts(read(spark, sf_dir, "orders"), lines), PRODUCER)


def _stripped(content: bytes) -> tuple[str, list[str]]:
    """A small converter: a page without its tags, and what is odd about it."""
    page = content.decode()
    text = re.sub("<[^>]*>", "", page)
    found = {"scripts are dropped": "<script" in page, "no heading": "<h1" not in page, "a link is lost": "<a " in page, "nothing is left": not text.strip(" \n")}
    if len(text) % 50 == 7:
        raise convert.InputError("a page of this length")
    return text, [k for k, holds in found.items() if holds]


def converted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through the converter as a table function, from SQL."""
    spark.udtf.register("convert_page", convert.table_function(lambda: _stripped))
    pages = read(spark, sf_dir, "pages").select("page_id", F.encode("html", "utf-8").alias("content"))
    return spark.sql("SELECT page_id, kind, seq, CASE WHEN kind = 'text' THEN sha2(encode(value, 'utf-8'), 256) ELSE value END AS value FROM {pages}, LATERAL convert_page(content)", pages=pages)


QUERIES = {f.__name__: f for f in (sidecar_reading, manifest_reading, report_issues, converted_pages)}

#: A path below its root that names something.
_SAFE = lambda p: rf"({p} <> '' AND NOT contains({p}, '\') AND NOT regexp_matches({p}, '^[A-Za-z]:') AND NOT starts_with({p}, '/') AND NOT list_contains(string_split({p}, '/'), '..') AND regexp_matches({p}, '(^|/)([^/.]|\.[^/.]|\.\.[^/])'))"
_SIDECARS = f"""WITH d AS (SELECT doc_id AS i, text, text[1:30] || '.pdf' AS ip, CASE WHEN doc_id % 83 = 0 THEN '' WHEN doc_id % 29 = 0 THEN '../up.md' ELSE concat_ws('/', source, doc_id) END AS op FROM documents),
c AS (SELECT *, CASE WHEN text IS NULL OR i % 79 = 0 OR i % 73 = 0 THEN 'invalid-json' WHEN i % 71 = 0 THEN 'invalid-schema' WHEN i % 61 = 0 OR i % 59 = 0 THEN 'unsupported-schema' WHEN i % 67 = 0 OR i % 43 = 0 AND i % 47 <> 0 THEN 'invalid-schema'
  WHEN NOT {_SAFE('ip')} OR NOT {_SAFE('op')} THEN 'outside-package-root' WHEN text = '' OR (i % 31 = 0 AND i % 3 <> 0) OR i % 47 = 0 OR i % 41 = 0 OR i % 37 = 0 OR (i % 53 = 0 AND i % 2 <> 0) THEN 'invalid-schema' ELSE '' END AS category FROM d)
SELECT i::VARCHAR AS path, category, CASE WHEN category = '' THEN op END AS output_path, CASE WHEN category = '' THEN CASE WHEN i % 3 = 0 THEN 'skipped' ELSE 'succeeded' END END AS status, CASE WHEN category = '' THEN strlen(text) END AS artifact_bytes,
  CASE WHEN category = '' THEN sha256(text) END AS artifact_sha256, CASE WHEN category = '' THEN i % 2 <> 0 END AS table_structure, CASE WHEN category = '' AND i % 2 = 0 THEN 'none' END AS profile FROM c"""
_MANIFESTS = f"""WITH d AS (SELECT doc_id AS i, text, source || '/' || lang || '/' || (doc_id % 300) AS m, doc_id % 300 AS k, text[1:30] || '.pdf' AS ip, CASE WHEN doc_id % 91 = 0 THEN 'a/../../b' WHEN doc_id % 23 = 0 THEN 'C:/x.md' ELSE source || '/' || doc_id END AS op FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
c AS (SELECT *, CASE WHEN i % 47 = 0 THEN 'invalid-json' WHEN i % 43 = 0 THEN 'invalid-schema' WHEN NOT {_SAFE('ip')} OR NOT {_SAFE('op')} THEN 'outside-package-root' WHEN i % 9 <> 0 AND (i % 41 = 0 OR i % 37 = 0 OR i % 31 = 0) THEN 'invalid-schema' ELSE '' END AS f FROM d),
h AS (SELECT DISTINCT m, CASE WHEN k % 37 = 0 THEN 'invalid-schema' WHEN k % 31 = 0 THEN 'invalid-json' WHEN k % 17 <> 0 AND k % 13 = 0 THEN 'unsupported-schema' WHEN k % 19 = 0 OR k % 29 = 0 THEN 'invalid-schema' ELSE '' END AS head FROM d),
b AS (SELECT m, count(*) AS n, min(CASE WHEN f <> '' THEN i END) AS bad, sum(CASE WHEN i % 9 = 0 AND i % 2 <> 0 THEN NULL WHEN i % 31 = 0 THEN -1 ELSE strlen(text) END)::BIGINT AS s, count(*) FILTER (i % 9 = 0) AS failed FROM c GROUP BY m),
r AS (SELECT b.*, head, CASE WHEN head <> '' THEN head ELSE coalesce((SELECT f FROM c WHERE c.m = b.m AND c.i = b.bad), '') END AS category FROM b JOIN h USING (m))
SELECT m AS manifest, category, CASE WHEN head = '' THEN bad END AS "at", n AS n_items, CASE WHEN category = '' THEN s END AS output_bytes, CASE WHEN category = '' THEN failed END AS failed FROM r"""
_REPORTS = """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS q, min(l_returnflag) AS r FROM lineitem GROUP BY 1, 2),
g AS (SELECT o, o // 5 AS k, o % 5 AS f, count(*) AS n, bool_or(n = 1) AS one, bool_or(n = 2) AS two, bool_or(n = 3) AS three, bool_or(n % 3 = 2) AS manual, bool_or(n = 1 AND r = 'A') AS one_a, bool_or(n = 1 AND r <> 'R') AS one_ready,
  bool_or(n % 3 = 1 AND n > 3 OR n % 3 = 1) AS stale, bool_or(n % 3 <> 2) AS any_repair, bool_or(n IN (1) ) AS first FROM l JOIN orders ON o_orderkey = o GROUP BY o)
SELECT o AS report, CASE WHEN k % 41 = 0 THEN 'letter' ELSE ['plan', 'approval', 'preflight', 'execution', 'cleanup-audit'][f + 1] END AS family,
CASE WHEN k % 41 = 0 THEN 'family' WHEN k % 43 = 0 THEN 'json' WHEN k % 29 = 0 OR k % 23 = 0 THEN 'type'
 WHEN (f = 0 AND k % 7 = 0 AND one) OR (f = 1 AND (k % 31 = 0 OR (k % 7 = 0 AND one))) OR (f = 2 AND (k % 19 = 0 OR (k % 17 = 0 AND any_repair))) OR (f = 3 AND k % 19 = 0) OR (f = 4 AND k % 19 = 0) THEN 'fields'
 WHEN f = 0 AND ((k % 11 = 0 AND two) OR k % 37 = 0 OR k % 31 <> 0) THEN 'rule'
 WHEN f = 1 AND k % 37 = 0 AND manual THEN 'rule'
 WHEN f = 2 AND (k % 31 = 0 OR (k % 13 = 0 AND one)) THEN 'rule'
 WHEN f = 3 AND (k % 31 = 0 OR (k % 13 = 0 AND one_a) OR (k % 11 = 0 AND three AND one)) THEN 'rule'
 WHEN f = 4 AND (k % 31 = 0 OR (k % 13 = 0 AND one_a)) THEN 'rule' ELSE '' END AS issue FROM g"""
_PAGES = r"""WITH p AS (SELECT page_id, html, regexp_replace(html, '<[^>]*>', '', 'g') AS t FROM pages), ok AS (SELECT * FROM p WHERE length(t) % 50 <> 7),
w AS (SELECT page_id, list_filter([CASE WHEN contains(html, '<script') THEN 'scripts are dropped' END, CASE WHEN NOT contains(html, '<h1') THEN 'no heading' END, CASE WHEN contains(html, '<a ') THEN 'a link is lost' END,
  CASE WHEN trim(t, ' ' || chr(10)) = '' THEN 'nothing is left' END], lambda x: x IS NOT NULL) AS ws FROM ok)
SELECT page_id, 'error' AS kind, 0::INTEGER AS seq, 'InputError' AS value FROM p WHERE length(t) % 50 = 7 UNION ALL SELECT page_id, 'text', 0, sha256(t) FROM ok
UNION ALL SELECT page_id, 'warning', unnest(range(len(ws)))::INTEGER, unnest(ws) FROM w"""
ORACLES = {"converted_pages": _PAGES, "sidecar_reading": _SIDECARS, "manifest_reading": _MANIFESTS, "report_issues": _REPORTS}
