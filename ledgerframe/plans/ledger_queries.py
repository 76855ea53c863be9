"""Registered queries over ledgers, backups and audits, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, paths
from ..operators import audit, backup, intent, ledger, repair
from ..sources.shared import settled
from .synth import read

MANIFEST_NAME = "artifact-manifest.json"


def _engine():
    return F.struct(F.lit("ledgerframe").alias("name"), F.lit("1").alias("version"))


def _settings(flag):
    return F.struct(flag.alias("table_structure"), F.lit("conservative").alias("normalization_profile"), F.lit(False).alias("artifacts_path_configured"))


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """items, sidecars and files over documents: stale, missing, tampered, moved and orphaned ones by id. The texts are read
    and digested once; all three come from the narrow rows."""
    i = F.col("doc_id")
    base = F.concat_ws("/", "source", "lang", i.cast("string"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", base.alias("base"))
    status = F.when(i % 20 == 0, "failed").when(i % 20 == 1, "skipped").otherwise("succeeded")
    rows = docs.select(i.alias("seq"), F.concat("base", F.lit(".pdf")).alias("input_path"), F.concat("base", F.lit(".md")).alias("output_path"), status.alias("status"), F.concat(F.lit("in"), i.cast("string")).alias("input_content"), F.col("text").alias("output_content"), "source", "lang")
    rows = settled(ledger.digested(rows))
    items = ledger.items_of(rows)
    own = rows.filter((F.col("seq") % 11 != 0) & ((F.col("status") != "failed") | (F.col("seq") % 40 == 0)))
    s = F.col("seq")
    where = F.concat(F.regexp_replace("output_path", r"\.md$", ""), F.lit(".metadata.json"))
    artifact = F.col("output")
    spoiled = F.struct(artifact["bytes"].alias("bytes"), F.when(s % 13 == 0, F.sha2(F.concat(F.lit("x"), s.cast("string")).cast("binary"), 256)).otherwise(artifact["sha256"]).alias("sha256"))
    sides = own.select(
        "seq", F.when(s % 29 == 0, F.upper(where)).otherwise(where).alias("sidecar_path"), "input_path",
        F.when(s % 37 == 0, F.concat(F.lit("moved/"), s.cast("string"), F.lit(".md"))).otherwise(F.col("output_path")).alias("output_path"),
        F.when(F.col("status") == "failed", "succeeded").otherwise(F.col("status")).alias("status"), F.col("input").alias("source"), spoiled.alias("artifact"), _engine().alias("engine"), _settings(s % 17 == 0).alias("settings"),
    )
    stray = rows.filter(s % 50 == 0).select(
        (s + 1000000000).alias("seq"), F.concat_ws("/", "source", "lang", F.concat((s + 1000000000).cast("string"), F.lit(".metadata.json"))).alias("sidecar_path"), "input_path",
        F.concat_ws("/", "source", "lang", F.concat((s + 1000000000).cast("string"), F.lit(".md"))).alias("output_path"), F.lit("succeeded").alias("status"), F.col("input").alias("source"), F.col("output").alias("artifact"), _engine().alias("engine"), _settings(F.lit(False)).alias("settings"),
    )
    disk = rows.filter((F.col("status") != "failed") & (s % 41 != 0)).select(F.col("output_path").alias("path"), F.col("output").alias("d"))
    extra = rows.filter(s % 60 == 0).select(F.concat_ws("/", "source", "lang", F.concat((s + 2000000000).cast("string"), F.lit(".MD"))).alias("path"), F.col("output").alias("d"))
    files = disk.union(extra).select("path", "d.bytes", "d.sha256")
    return items, sides.unionByName(stray), files


def _issues(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    items, sides, files = _ledger(spark, sf_dir)
    return ledger.reconcile(items, sides, files, _engine(), _settings(F.lit(False)), strict)


def _settled_issues(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    """For what looks at the issues more than once."""
    return settled(_issues(spark, sf_dir, strict))


def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch would convert: filtered by patterns, without what exists already."""
    items, _, files = _ledger(spark, sf_dir)
    requests = items.select("seq", "input_path").filter(paths.matches(F.col("input_path"), ("src*/**/*.pdf",), ("**/de/**", "src3/*/*")))
    requests = requests.withColumn("output_path", paths.with_suffix(F.col("input_path"), ".md"))
    done = files.filter("bytes > 2000").select(F.col("path").alias("output_path"))
    marked = requests.join(done.withColumn("there", F.lit(True)), "output_path", "left")
    return marked.select("input_path", "output_path", F.when(F.col("there"), "skipped").otherwise("pending").alias("state"), keys.folded(F.col("input_path")).alias("order_key"))


def output_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.concat(F.when(i % 2 == 0, F.lit("CAFÉ/")).otherwise(F.lit("café/")), "source", F.lit("/"), (i % 13).cast("string"), F.lit(".md"))
    rows = read(spark, sf_dir, "documents").select(name.alias("output_path"))
    return ledger.collisions(rows)


def manifest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir)[0].select("output_path", "status", F.col("input.bytes").alias("input_bytes"), F.col("input.sha256").alias("input_sha256"), F.col("output.bytes").alias("output_bytes"), F.col("output.sha256").alias("output_sha256"))


def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.manifest_summary(_ledger(spark, sf_dir)[0])


def failure_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    raised = F.when(i % 60 == 0, "InputError").when(i % 60 == 20, "FileExistsError").otherwise("ConverterError")
    rows = read(spark, sf_dir, "documents").select(F.when(i % 20 == 0, "failed").when(i % 20 == 1, "skipped").otherwise("succeeded").alias("status"), F.when(i % 20 == 0, ledger.failure_category(raised)).alias("category"))
    return ledger.failure_breakdown(rows)


def reconcile_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, sides, files = _ledger(spark, sf_dir)
    issues = ledger.reconcile(items, sides, files, _engine(), _settings(F.lit(False)))
    return ledger.validation_summary(items, sides, issues)


def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.plan(_settled_issues(spark, sf_dir, strict=True), MANIFEST_NAME)


def repair_plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = _settled_issues(spark, sf_dir)
    return repair.plan_summary(issues, repair.plan(issues, MANIFEST_NAME))


def approval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.approvable(repair.plan(_settled_issues(spark, sf_dir), MANIFEST_NAME)).select("path", "action", "reason")


def _preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, sides, files = _ledger(spark, sf_dir)
    issues = settled(ledger.reconcile(items, sides, files, _engine(), _settings(F.lit(False))))
    on_disk = sides.select(F.col("sidecar_path").alias("path"), F.lit(100).cast("long").alias("bytes"), F.sha2(F.col("sidecar_path").cast("binary"), 256).alias("sha256"))
    return repair.preflight(repair.approvable(repair.plan(issues, MANIFEST_NAME)), issues, items, files.unionByName(on_disk))


def preflight_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preflight(spark, sf_dir).select("path", "action", "status", "block_reason", "backup_required", F.col("target.exists").alias("target_exists"))


def preflight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.preflight_summary(_preflight(spark, sf_dir))


def _backup(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers as sessions, parts as their files."""
    k = F.col("s_suppkey")
    sup = read(spark, sf_dir, "supplier")
    name = F.when(k % 19 == 0, F.concat(F.lit("-bad name "), k.cast("string"))).otherwise(F.concat(F.lit("session-"), k.cast("string")))
    manifest = F.when(k % 13 == 0, "absent").when(k % 11 == 0, "unbound").when(k % 17 == 0, "invalid").otherwise("valid")
    state = F.when(k % 5 == 0, "open").when(k % 7 == 0, "rollback-failed").otherwise("complete")
    sessions = sup.select(name.alias("session"), (k % 23 == 0).alias("is_link"), F.lit(True).alias("is_dir"), manifest.alias("manifest"), state.alias("state"), F.sha2(k.cast("string").cast("binary"), 256).alias("manifest_sha256"), k.alias("k"))
    p = F.col("p_partkey")
    n = sup.agg(F.count("*").alias("n"))
    parts = read(spark, sf_dir, "part").crossJoin(F.broadcast(n)).withColumn("k", p % F.col("n") + 1)  # one row
    own = parts.join(sessions.select("k", "session"), "k").select("session", F.concat(F.lit("package/"), (p % 3).cast("string"), F.lit("/"), p.cast("string"), F.lit(".bak")).alias("backup"), F.length("p_name").cast("long").alias("bytes"), F.sha2(F.col("p_name").cast("binary"), 256).alias("sha256"), p.alias("p"))
    items = own.drop("p")
    disk = own.filter(F.col("p") % 101 != 0).select("session", F.col("backup").alias("path"), F.lit("file").alias("kind"), F.when(F.col("p") % 53 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), "sha256")
    dirs = backup.expected_directories(items).select("session", "path", F.lit("dir").alias("kind"), F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("string").alias("sha256"))
    own_file = sessions.select("session", F.lit(backup.MANIFEST).alias("path"), F.lit("file").alias("kind"), F.lit(1).cast("long").alias("bytes"), F.col("manifest_sha256").alias("sha256"))
    return sessions.drop("k"), items, disk.unionByName(dirs).unionByName(own_file)


def inventory_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backup.classified(*_backup(spark, sf_dir))


def inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backup.inventory_summary(backup.classified(*_backup(spark, sf_dir)))


def expected_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backup.expected_directories(_backup(spark, sf_dir)[1])


def cleanup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    requested = read(spark, sf_dir, "supplier").select(F.concat(F.lit("SESSION-"), (k + F.when(k % 10 == 0, 100000).otherwise(0)).cast("string")).alias("session"))
    return backup.cleanup_plan(requested, backup.classified(*_backup(spark, sf_dir)))


def session_tree_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as files of their orders' sessions."""
    rows = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("session"), F.concat(F.lit("Line/"), F.col("l_linenumber").cast("string")).alias("path"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).cast("binary").alias("content"))
    return backup.tree_digests(rows)


def failfast_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"))  # numbers can repeat
    return repair.fail_fast(rows, ["l_orderkey"], "l_linenumber", F.col("l_returnflag") == "A").select("l_orderkey", "l_linenumber", "outcome", "first_failure")


def _repair_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as execution reports with their lines as actions."""
    state = lambda there, size: F.struct(there.alias("exists"), size.cast("long").alias("bytes"), F.sha2(size.cast("string").cast("binary"), 256).alias("sha256"))

    def act(line: Column) -> Column:
        n, q = line["l_linenumber"], line["l_partkey"]
        status = F.when(line["l_returnflag"] == "A", "succeeded").when(line["l_returnflag"] == "R", "rolled-back").when(line["l_linestatus"] == "O", "failed").when(n % 2 == 0, "rollback-failed").otherwise("failed-precondition")
        return F.struct(
            (n - 1).alias("i"), F.when(n % 2 == 0, "regenerate-sidecar").otherwise("remove-stale-sidecar").alias("action"), F.concat(F.lit("p/"), q.cast("string")).alias("path"), status.alias("status"), F.lit("not-required").alias("rollback"),
            state(F.lit(True), F.when(q % 5 == 0, None).otherwise(q)).alias("before"), state(F.lit(True), q + F.when(q % 3 == 0, 1).otherwise(0)).alias("after"),
        )

    # An order's lines: a handful. They are shuffled as they are, and digested where they are together.
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")).alias("lines"))
    return lines.select("l_orderkey", F.sha2(F.col("l_orderkey").cast("string").cast("binary"), 256).alias("sha256"), F.sort_array(F.transform("lines", act)).alias("actions"))


def audit_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.repair_operations(_repair_reports(spark, sf_dir)).drop("scope", "rollback").withColumn("action_index", F.col("action_index").cast("long"))


def _cleanup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    status = F.when(e % 10 == 0, "failed").when(e % 7 == 0, "not-run").otherwise("deleted")
    return read(spark, sf_dir, "events").select(F.sha2(F.col("event_type").cast("binary"), 256).alias("sha256"), e.alias("action_index"), F.concat(F.lit("session-"), e.cast("string")).alias("session"), status.alias("status"))


def audit_cleanup_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.cleanup_facts(_cleanup_rows(spark, sf_dir)).groupBy("sha256", "outcome", "reason", "operator_required").agg(F.count("*").alias("n"))


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    operations = audit.repair_operations(_repair_reports(spark, sf_dir)).unionByName(audit.cleanup_facts(_cleanup_rows(spark, sf_dir)))
    return audit.summary(operations, "source_type")


def source_multiset_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is an expected and a provided source; some are provided with other bytes."""
    k = F.col("o_orderkey")
    sha = lambda x: F.sha2(x.cast("string").cast("binary"), 256).alias("sha256")
    kind = F.col("o_orderpriority").alias("source_type")
    orders = read(spark, sf_dir, "orders")
    got = audit.multiset(orders.select(kind, sha(k % 500)), orders.select(kind, sha(k % F.when(k % 5 == 0, 700).otherwise(500))))
    return got.withColumn("exit_code", audit.verification_exit(F.lit(True), F.col("missing"), F.col("unexpected")))


def contiguous_index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - F.when(F.col("l_partkey") % 50 == 0, 0).otherwise(1)).alias("i"))
    return audit.contiguous(rows, ["l_orderkey"], "i")


def intent_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a receipt and a final report; a third of the reports are handed in for the next receipt."""
    o = F.col("o_orderkey")
    sha = lambda x: F.sha2(x.cast("string").cast("binary"), 256)
    orders = read(spark, sf_dir, "orders")
    receipts = orders.select(
        o.alias("receipt_id"), sha(o).alias("sha256"), F.concat(F.lit("attempt-"), o.cast("string")).alias("attempt_id"), F.lit("repair").alias("operation_type"), F.array((o % 7).cast("string")).alias("actions"),
        F.create_map(F.lit("plan"), sha(o)).alias("bindings"), F.when(o % 4 == 0, "binding-mismatch").when(o % 4 == 1, "verified").alias("lifecycle"),
    )
    reports = orders.select(
        F.when(o % 3 == 1, o + 1).otherwise(o).alias("receipt_id"), F.when(o % 5 == 0, None).when(o % 7 == 0, "other").otherwise(sha(o)).alias("receipt_sha256"), F.concat(F.lit("attempt-"), (o + F.when(o % 11 == 0, 1).otherwise(0)).cast("string")).alias("attempt_id"),
        F.when(o % 17 == 0, "cleanup").otherwise("repair").alias("operation_type"), F.array((o % F.when(o % 13 == 0, 3).otherwise(7)).cast("string")).alias("actions"), F.create_map(F.lit("plan"), F.when(o % 6 == 0, "none").otherwise(sha(o))).alias("bindings"),
    )
    return intent.paired(receipts, reports)


def context_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order has an expected and a provided projection; some are provided under another digest."""
    k = F.col("o_orderkey")
    sha = lambda x: F.sha2(x.cast("string").cast("binary"), 256).alias("sha256")
    orders = read(spark, sf_dir, "orders")
    a = orders.select("o_orderpriority", sha(k), (k % 10).alias("projection"))
    b = orders.select("o_orderpriority", sha(F.when(k % 7 == 0, k + 1000000000).otherwise(k)), (k % F.when(k % 5 == 0, 9).otherwise(10)).alias("projection"))
    return audit.context_verified(a, b, "o_orderpriority")


def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(F.floor(e / 2).alias("case"), F.when(e % 2 == 0, "baseline").otherwise("table").alias("mode"), (e % 3 != 0).alias("passed"), F.round(e % 100 / 10, 3).alias("seconds"))
    return audit.compared_modes(rows).filter("baseline_seconds is not null and table_seconds is not null")


QUERIES = {
    f.__name__: f
    for f in (
        batch_plan, output_collisions, manifest_items, manifest_summary, failure_breakdown, reconcile_issues, validation_summary, repair_plan, repair_plan_summary, approval_set, preflight_status, preflight_summary,
        inventory_classification, inventory_summary, expected_directories, cleanup_plan, session_tree_hash, failfast_statuses, audit_operations, audit_cleanup_operations, audit_summary, source_multiset_verify,
        contiguous_index_check, intent_pairing, context_verify, mode_comparison,
    )
}

_LEDGER = r"""
r AS (SELECT doc_id AS s, source || '/' || lang || '/' AS dir, source || '/' || lang || '/' || doc_id AS base, CASE doc_id % 20 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'succeeded' END AS status,
  strlen('in' || doc_id) AS ib, sha256('in' || doc_id) AS ish, strlen(text) AS ob, sha256(text) AS osh FROM documents),
it AS (SELECT s, base || '.pdf' AS ip, base || '.md' AS op, status, ib, ish, CASE WHEN status <> 'failed' THEN ob END AS ob, CASE WHEN status <> 'failed' THEN osh END AS osh, base || '.metadata.json' AS ex FROM r),
sd AS (SELECT CASE WHEN s % 29 = 0 THEN upper(base || '.metadata.json') ELSE base || '.metadata.json' END AS sp, base || '.pdf' AS ip, CASE WHEN s % 37 = 0 THEN 'moved/' || s || '.md' ELSE base || '.md' END AS op,
   CASE WHEN status = 'failed' THEN 'succeeded' ELSE status END AS status, ib, ish, ob, CASE WHEN s % 13 = 0 THEN sha256('x' || s) ELSE osh END AS osh, s % 17 = 0 AS ts FROM r WHERE s % 11 <> 0 AND (status <> 'failed' OR s % 40 = 0)
  UNION ALL SELECT dir || (s + 1000000000) || '.metadata.json', base || '.pdf', dir || (s + 1000000000) || '.md', 'succeeded', ib, ish, ob, osh, false FROM r WHERE s % 50 = 0),
fl AS (SELECT base || '.md' AS path, ob, osh FROM r WHERE status <> 'failed' AND s % 41 <> 0 UNION ALL SELECT dir || (s + 2000000000) || '.MD', ob, osh FROM r WHERE s % 60 = 0)
"""
_KEY = lambda x: f"lower(nfc_normalize({x}))"
_ISSUES = f"""{_LEDGER},
sx AS (SELECT sd.*, regexp_replace(op, '\\.md$', '.metadata.json') AS own, fl.path AS fp, fl.ob AS fob, fl.osh AS fosh FROM sd LEFT JOIN fl ON sd.op = fl.path),
j AS (SELECT it.*, sd.sp, sd.ip AS sip, sd.op AS sop, sd.status AS ss, sd.ib AS sib, sd.ish AS sish, sd.ob AS sob, sd.osh AS sosh, sd.ts FROM it FULL OUTER JOIN sd ON {_KEY('it.ex')} = {_KEY('sd.sp')}),
iss AS (
 SELECT sp AS path, 'error' AS severity, 'path-mismatch' AS category, 'sidecar path' AS detail FROM sx WHERE {_KEY('sp')} <> {_KEY('own')}
 UNION ALL SELECT sp, 'error', 'missing-artifact', 'no file' FROM sx WHERE fp IS NULL
 UNION ALL SELECT sp, 'error', 'artifact-size-mismatch', 'size' FROM sx WHERE fob <> ob
 UNION ALL SELECT sp, 'error', 'artifact-digest-mismatch', 'digest' FROM sx WHERE fosh <> osh
 UNION ALL SELECT sp, 'error', 'stale-sidecar', 'failed item' FROM j WHERE status = 'failed' AND sp IS NOT NULL
 UNION ALL SELECT ex, 'error', 'missing-sidecar', 'no sidecar' FROM j WHERE status <> 'failed' AND sp IS NULL
 UNION ALL SELECT sp, 'error', 'path-mismatch', 'document path' FROM j WHERE status <> 'failed' AND sp IS NOT NULL AND ({_KEY('sip')} <> {_KEY('ip')} OR {_KEY('sop')} <> {_KEY('op')})
 UNION ALL SELECT sp, 'error', 'manifest-sidecar-mismatch', 'status or engine' FROM j WHERE status <> 'failed' AND sp IS NOT NULL AND ss <> status
 UNION ALL SELECT sp, 'error', 'settings-mismatch', 'settings' FROM j WHERE status <> 'failed' AND sp IS NOT NULL AND ts
 UNION ALL SELECT sp, 'error', 'manifest-sidecar-mismatch', 'digest' FROM j WHERE status <> 'failed' AND sp IS NOT NULL AND (sib <> ib OR sish <> ish OR sob <> ob OR sosh <> osh)
 UNION ALL SELECT sp, 'error', 'orphan-sidecar', 'no item' FROM j WHERE s IS NULL
 UNION ALL SELECT path, 'warning', 'extra-artifact', 'not in manifest' FROM fl WHERE lower(path) LIKE '%.md' AND {_KEY('path')} NOT IN (SELECT {_KEY('op')} FROM it)),
pl AS (SELECT path, CASE category WHEN 'missing-sidecar' THEN 'regenerate-sidecar' WHEN 'stale-sidecar' THEN 'remove-stale-sidecar' WHEN 'extra-artifact' THEN 'regenerate-manifest' ELSE 'manual-review' END AS action,
  category AS reason, category IN ('missing-sidecar', 'stale-sidecar') AS safe, severity FROM iss),
pf AS (SELECT pl.path, pl.action, pl.action = 'remove-stale-sidecar' AS backup_required, t.sp IS NOT NULL AS target_exists,
  CASE pl.action WHEN 'regenerate-sidecar' THEN t.sp IS NULL AND fl.path IS NOT NULL AND fl.ob = it.ob AND fl.osh = it.osh ELSE it.status = 'failed' AND t.sp IS NOT NULL END AS fine
  FROM pl LEFT JOIN sd t ON t.sp = pl.path LEFT JOIN it ON {_KEY('it.ex')} = {_KEY('pl.path')} LEFT JOIN fl ON fl.path = it.op WHERE safe)
"""
_BACKUP = r"""
s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 19 = 0 THEN '-bad name ' || s_suppkey ELSE 'session-' || s_suppkey END AS session, s_suppkey % 23 = 0 AS is_link,
  CASE WHEN s_suppkey % 13 = 0 THEN 'absent' WHEN s_suppkey % 11 = 0 THEN 'unbound' WHEN s_suppkey % 17 = 0 THEN 'invalid' ELSE 'valid' END AS manifest,
  CASE WHEN s_suppkey % 5 = 0 THEN 'open' WHEN s_suppkey % 7 = 0 THEN 'rollback-failed' ELSE 'complete' END AS state, sha256(s_suppkey::VARCHAR) AS sha FROM supplier),
i AS (SELECT s.session, p_partkey AS p, 'package/' || (p_partkey % 3) || '/' || p_partkey || '.bak' AS backup, length(p_name) AS bytes FROM part JOIN s ON s.k = p_partkey % (SELECT count(*) FROM supplier) + 1),
a AS (SELECT session, count(*) AS n, sum(bytes) AS b, bool_or(p % 101 = 0) AS lost, bool_or(p % 53 = 0) AS changed FROM i GROUP BY 1),
c AS (SELECT s.*, n, b, CASE WHEN NOT regexp_full_match(s.session, '[A-Za-z0-9][A-Za-z0-9._-]*') OR is_link THEN 'unexpected-entry' WHEN manifest = 'absent' THEN 'missing-session-manifest' WHEN manifest = 'unbound' THEN 'binding-unverifiable'
  WHEN manifest <> 'valid' THEN 'invalid-session-manifest' WHEN coalesce(lost, false) THEN 'unexpected-entry' WHEN coalesce(changed, false) THEN 'invalid-session-manifest' WHEN state = 'open' THEN 'interrupted-open-session' ELSE 'managed' END AS classification FROM s LEFT JOIN a USING (session)),
inv AS (SELECT CASE WHEN regexp_full_match(session, '[A-Za-z0-9][A-Za-z0-9._-]*') THEN session ELSE 'invalid-session-' || sha256(session) END AS session, classification, CASE WHEN manifest = 'valid' THEN state END AS state,
  classification = 'managed' AND state = 'complete' AS planning_eligible, CASE WHEN classification IN ('managed', 'interrupted-open-session') THEN sha END AS manifest_sha256,
  CASE WHEN classification IN ('managed', 'interrupted-open-session') THEN coalesce(n, 0) ELSE 0 END::BIGINT AS n_items, CASE WHEN classification IN ('managed', 'interrupted-open-session') THEN coalesce(b, 0) ELSE 0 END::BIGINT AS bytes FROM c)
"""
_OPS = r"""
o0 AS (SELECT *,
  CASE WHEN l_returnflag = 'A' THEN 'succeeded' WHEN l_returnflag = 'R' THEN 'rolled-back' WHEN l_linestatus = 'O' THEN 'failed' WHEN l_linenumber % 2 = 0 THEN 'rollback-failed' ELSE 'failed-precondition' END AS status FROM lineitem),
o AS (SELECT 'repair-execution' AS source_type, sha256(l_orderkey::VARCHAR) AS sha256, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'p/' || l_partkey, status) - 1 AS action_index,
  'repair-' || CASE WHEN l_linenumber % 2 = 0 THEN 'regenerate-sidecar' ELSE 'remove-stale-sidecar' END AS operation, 'p/' || l_partkey AS target, status,
  CASE WHEN l_partkey % 5 = 0 THEN 'unknown' WHEN l_partkey % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS package_change FROM o0),
ro AS (SELECT *, CASE status WHEN 'succeeded' THEN 'succeeded' WHEN 'rolled-back' THEN 'rolled_back' WHEN 'rollback-failed' THEN 'partial' WHEN 'failed-precondition' THEN 'failed' ELSE CASE WHEN package_change = 'changed' THEN 'partial' ELSE 'failed' END END AS outcome,
  CASE status WHEN 'succeeded' THEN 'completed' WHEN 'rolled-back' THEN 'rolled-back' WHEN 'rollback-failed' THEN 'rollback-failed' WHEN 'failed-precondition' THEN 'precondition-failed' ELSE CASE WHEN package_change = 'unknown' THEN 'source-failure-mutation-unknown' ELSE 'execution-failed' END END AS reason FROM o),
co AS (SELECT 'backup-cleanup-audit' AS source_type, sha256(event_type) AS sha256, CASE WHEN event_id % 10 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'not_run' ELSE 'succeeded' END AS outcome,
  CASE WHEN event_id % 10 = 0 THEN 'cleanup-failed' WHEN event_id % 7 = 0 THEN 'not-run' ELSE 'completed' END AS reason, 'unknown' AS package_change FROM events)
"""
_PAIR = r"""
f AS (SELECT CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey + 1 ELSE o_orderkey END AS k, count(*) AS n, min(o_orderkey) AS o FROM orders GROUP BY 1),
x AS (SELECT o_orderkey AS c, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN CASE WHEN o % 5 = 0 THEN 'legacy-final-report' WHEN o % 7 = 0 OR o <> o_orderkey THEN 'receipt-sha256-mismatch' WHEN o % 11 = 0 THEN 'attempt-id-mismatch'
   WHEN o % 17 = 0 THEN 'operation-type-mismatch' WHEN o % 13 = 0 AND o % 3 <> o % 7 THEN 'action-scope-mismatch' WHEN o % 6 = 0 THEN 'binding-scope-mismatch' END END AS conflict,
   CASE WHEN o_orderkey % 4 = 0 THEN 'lifecycle-binding-mismatch' END AS life FROM orders LEFT JOIN f ON k = o_orderkey),
y AS (SELECT *, CASE WHEN n = 0 THEN CASE WHEN life IS NOT NULL THEN 'stale' ELSE 'orphan' END WHEN n > 1 OR conflict IS NOT NULL THEN 'conflicting' ELSE 'paired' END AS classification FROM x)
"""
ORACLES = {
    "batch_plan": f"WITH {_LEDGER} SELECT it.ip AS input_path, it.op AS output_path, CASE WHEN fl.path IS NOT NULL THEN 'skipped' ELSE 'pending' END AS state, lower(it.ip) AS order_key FROM it LEFT JOIN fl ON fl.path = it.op AND fl.ob > 2000 WHERE it.ip LIKE 'src%/%.pdf' AND it.ip NOT LIKE '%/de/%' AND NOT regexp_full_match(it.ip, 'src3/[^/]*/[^/]*')",
    "output_collisions": f"WITH n AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'CAFÉ/' ELSE 'cafe' || chr(769) || '/' END || source || '/' || (doc_id % 13) || '.md' AS p FROM documents) SELECT {_KEY('p')} AS key, count(*) AS n, min(p) AS first FROM n GROUP BY 1 HAVING count(*) > 1",
    "manifest_items": f"WITH {_LEDGER} SELECT op AS output_path, status, ib AS input_bytes, ish AS input_sha256, ob AS output_bytes, osh AS output_sha256 FROM it",
    "manifest_summary": f"WITH {_LEDGER} SELECT count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM it",
    "failure_breakdown": "SELECT count(*) AS total, count(*) FILTER (doc_id % 20 > 1) AS succeeded, count(*) FILTER (doc_id % 20 = 1) AS skipped, count(*) FILTER (doc_id % 20 = 0) AS failed, count(*) FILTER (doc_id % 60 = 0) AS failed_input, count(*) FILTER (doc_id % 60 = 20) AS failed_output, count(*) FILTER (doc_id % 60 = 40) AS failed_converter, 0::BIGINT AS failed_unexpected FROM documents",
    "reconcile_issues": f"WITH {_ISSUES} SELECT * FROM iss",
    "validation_summary": f"WITH {_ISSUES}, ck AS (SELECT sp AS p FROM sd UNION SELECT ex FROM it UNION SELECT path FROM iss WHERE category = 'extra-artifact'), n AS (SELECT count(DISTINCT path) FILTER (severity = 'error') AS failed, count(DISTINCT path) FILTER (severity = 'warning') AS warnings FROM iss) SELECT (SELECT count(*) FROM ck) AS checked, greatest((SELECT count(*) FROM ck) - failed, 0) AS passed, failed, warnings FROM n",
    "repair_plan": f"WITH {_ISSUES} SELECT path, action, reason, safe FROM pl",
    "repair_plan_summary": f"WITH {_ISSUES} SELECT (SELECT count(*) FROM iss) AS issues, count(*) AS actions, count(*) FILTER (action = 'manual-review') AS manual_review FROM pl WHERE severity <> 'warning'",
    "approval_set": f"WITH {_ISSUES} SELECT path, action, reason FROM pl WHERE safe",
    "preflight_status": f"WITH {_ISSUES} SELECT path, action, CASE WHEN fine THEN 'ready' ELSE 'blocked' END AS status, CASE WHEN NOT fine THEN 'package-state-changed' END AS block_reason, backup_required, target_exists FROM pf",
    "preflight_summary": f"WITH {_ISSUES} SELECT count(*) AS actions, count(*) FILTER (fine) AS ready, count(*) FILTER (NOT fine) AS blocked, CASE WHEN count(*) FILTER (NOT fine) > 0 THEN 1 ELSE 0 END AS exit_code FROM pf",
    "inventory_classification": f"WITH {_BACKUP} SELECT * FROM inv",
    "inventory_summary": f"WITH {_BACKUP} SELECT count(*) AS sessions, count(*) FILTER (classification = 'managed') AS managed, 0::BIGINT AS legacy, count(*) FILTER (classification <> 'managed') AS orphaned, count(*) FILTER (planning_eligible) AS planning_eligible, sum(n_items)::BIGINT AS items, sum(bytes)::BIGINT AS bytes, CASE WHEN bool_or(classification <> 'managed' OR coalesce(state = 'rollback-failed', false)) THEN 1 ELSE 0 END AS exit_code FROM inv",
    "expected_directories": f"WITH {_BACKUP} SELECT session, 'package' AS path FROM i UNION SELECT session, 'package/' || (p % 3) FROM i",
    "cleanup_plan": f"WITH {_BACKUP}, q AS (SELECT 'SESSION-' || (s_suppkey + CASE WHEN s_suppkey % 10 = 0 THEN 100000 ELSE 0 END) AS session FROM supplier) SELECT coalesce(inv.session, q.session) AS session, CASE WHEN planning_eligible THEN manifest_sha256 END AS manifest_sha256, CASE WHEN planning_eligible THEN n_items ELSE 0 END AS files, CASE WHEN planning_eligible THEN inv.bytes ELSE 0 END AS bytes, coalesce(planning_eligible, false) AS eligible FROM q LEFT JOIN inv ON {_KEY('q.session')} = {_KEY('inv.session')}",
    "session_tree_hash": r"""WITH f AS (SELECT 'order-' || l_orderkey AS session, encode('Line/' || l_linenumber) AS p, encode('part ' || l_partkey) AS c FROM lineitem),
b AS (SELECT session, p, c, 'file\x00'::BLOB || unhex(lpad(to_hex(octet_length(p)), 16, '0')) || p || unhex(lpad(to_hex(octet_length(c)), 16, '0')) || c AS frame FROM f)
SELECT session, sha256(list_reduce(list(frame ORDER BY p, c), lambda x, y: x || y)) AS tree_sha256 FROM b GROUP BY session""",
    "failfast_statuses": "WITH l AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2), f AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'A' AS bad, min(CASE WHEN l_returnflag = 'A' THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS first_failure FROM l) SELECT l_orderkey, l_linenumber, CASE WHEN first_failure < l_linenumber THEN 'not-run' WHEN bad THEN 'failed' ELSE 'done' END AS outcome, first_failure FROM f",
    "audit_operations": f"WITH {_OPS} SELECT source_type, sha256, action_index, operation, target, status, outcome, package_change, outcome <> 'succeeded' AS operator_required, reason FROM ro",
    "audit_cleanup_operations": f"WITH {_OPS} SELECT sha256, outcome, reason, outcome <> 'succeeded' AS operator_required, count(*) AS n FROM co GROUP BY ALL",
    "audit_summary": f"WITH {_OPS}, u AS (SELECT source_type, outcome, package_change FROM ro UNION ALL SELECT source_type, outcome, package_change FROM co) SELECT source_type, count(*) AS operations, count(*) FILTER (outcome = 'succeeded') AS succeeded, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'partial') AS partial, count(*) FILTER (outcome = 'rolled_back') AS rolled_back, count(*) FILTER (outcome = 'not_run') AS not_run, count(*) FILTER (outcome <> 'succeeded') AS operator_required, CASE WHEN bool_or(package_change = 'changed') THEN true WHEN bool_and(package_change = 'unchanged') THEN false END AS package_changed FROM u GROUP BY 1",
    "source_multiset_verify": "WITH e AS (SELECT o_orderpriority AS t, o_orderkey % 500 AS h, count(*) AS e FROM orders GROUP BY 1, 2), p AS (SELECT o_orderpriority AS t, o_orderkey % CASE WHEN o_orderkey % 5 = 0 THEN 700 ELSE 500 END AS h, count(*) AS p FROM orders GROUP BY 1, 2), r AS (SELECT coalesce(e, 0) AS e, coalesce(p, 0) AS p FROM e FULL OUTER JOIN p ON e.t = p.t AND e.h = p.h), m AS (SELECT sum(least(e, p))::BIGINT AS matched, sum(greatest(e - p, 0))::BIGINT AS missing, sum(greatest(p - e, 0))::BIGINT AS unexpected FROM r) SELECT *, CASE WHEN missing > 0 OR unexpected > 0 THEN 1 ELSE 0 END AS exit_code FROM m",
    "contiguous_index_check": "WITH i AS (SELECT l_orderkey, l_linenumber - CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE 1 END AS i FROM lineitem), r AS (SELECT l_orderkey, i, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) - 1 AS n FROM i) SELECT l_orderkey, bool_and(i = n) AS contiguous, count(*) AS n FROM r GROUP BY 1",
    "intent_pairing": f"WITH {_PAIR} SELECT c AS receipt_id, classification, CASE WHEN n = 0 THEN coalesce(life, 'final-report-missing') WHEN n > 1 THEN 'multiple-final-reports' WHEN conflict IS NOT NULL THEN conflict ELSE coalesce(life, 'paired') END AS reason, n AS n_reports, classification <> 'paired' OR life IS NOT NULL AS operator_required, CASE WHEN classification = 'paired' THEN 0 ELSE 1 END AS exit_code FROM y",
    "context_verify": "SELECT o_orderpriority, count(*) FILTER (o_orderkey % 7 = 0) AS missing, count(*) FILTER (o_orderkey % 7 = 0) AS unexpected, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 AND o_orderkey % 9 <> o_orderkey % 10) AS different, bool_and(o_orderkey % 7 <> 0 AND (o_orderkey % 5 <> 0 OR o_orderkey % 9 = o_orderkey % 10)) AS verified FROM orders GROUP BY 1",
    "mode_comparison": "WITH r AS (SELECT event_id // 2 AS k, event_id % 2 AS m, event_id % 3 <> 0 AS ok, round(event_id % 100 / 10, 3) AS sec FROM events), b AS (SELECT * FROM r WHERE m = 0), t AS (SELECT * FROM r WHERE m = 1) SELECT b.k AS \"case\", b.ok AS baseline_passed, t.ok AS table_passed, b.sec AS baseline_seconds, t.sec AS table_seconds, round(t.sec - b.sec, 3) AS delta, b.ok AND NOT t.ok AS regressed, NOT b.ok AND t.ok AS improved FROM b JOIN t ON b.k = t.k",
}
