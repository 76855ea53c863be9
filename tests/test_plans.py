"""What the executed plans of ledger queries cost: scans of the documents, shuffles, passes through Python."""

import re

import pytest

from ledgerframe.operators import ledger, repair
from ledgerframe.plans import ledger_queries as L
from ledgerframe.plans import report_queries
from ledgerframe.sources.shared import settled


def counts(frame):
    """Of the plan that ran: exchanges, Python nodes, scans; those that were reused count once."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    rows = [line for line in plan.splitlines() if "Reused" not in line]
    has = lambda word: sum(bool(re.search(word, r)) for r in rows)
    return has(r"^[\s:|+*-]*(\(\d+\) )?Exchange"), has("ArrowEvalPython|BatchEvalPython"), has("FileScan|Scan ExistingRDD")


@pytest.mark.parametrize(("query", "exchanges"), [(L.preflight_status, 6), (L.repair_plan, 1), (L.reconcile_issues, 8), (L.validation_summary, 10)])
def test_shuffles(spark, sf_dir, query, exchanges):
    found = query(spark, sf_dir)
    made, _, scans = counts(found)
    assert made <= exchanges
    assert "documents.parquet" not in found._jdf.queryExecution().optimizedPlan().toString()  # texts are read once, before


def test_one_python_node_a_side(spark, sf_dir):
    """Items and files are looked at twice, by sidecar and by path of the document; sidecars once."""
    items, sides, files = map(settled, L._ledger(spark, sf_dir))
    issues = ledger.reconcile(items, sides, files, L._engine(), L._settings(L.F.lit(False)))
    exchanges, python, scans = counts(issues)
    assert python <= 5 and scans == 5 and exchanges <= 7


def test_issues_without_a_manifest(spark, sf_dir):
    items, sides, files = L._ledger(spark, sf_dir)
    alone = {tuple(r) for r in ledger.reconcile(None, sides, files).collect()}
    whole = {tuple(r) for r in ledger.reconcile(items, sides, files, L._engine(), L._settings(L.F.lit(False))).collect()}
    assert alone and alone < whole


def test_of_sidecars_with_one_key_the_latest_counts(spark):
    digest = (1, "0" * 64)
    kind = "struct<bytes:long,sha256:string>"
    items = spark.createDataFrame([(1, "a.pdf", "a.md", "succeeded", digest, digest)], f"seq long, input_path string, output_path string, status string, input {kind}, output {kind}")
    side = lambda seq, path, status: (seq, path, "a.pdf", "a.md", status, digest, digest, ("ledgerframe", "1"), (False, "conservative", False))
    schema = f"seq long, sidecar_path string, input_path string, output_path string, status string, source {kind}, artifact {kind}, engine struct<name:string,version:string>, settings struct<table_structure:boolean,normalization_profile:string,artifacts_path_configured:boolean>"
    files = spark.createDataFrame([("a.md", 1, "0" * 64)], "path string, bytes long, sha256 string")
    tell = lambda *rows: sorted(r.category for r in ledger.reconcile(items, spark.createDataFrame(list(rows), schema), files, L._engine(), L._settings(L.F.lit(False))).collect())
    assert tell(side(1, "A.metadata.json", "skipped"), side(2, "a.metadata.json", "succeeded")) == []
    assert tell(side(3, "A.metadata.json", "skipped"), side(2, "a.metadata.json", "succeeded")) == ["manifest-sidecar-mismatch"]
    assert ledger.reconcile(items.limit(0), spark.createDataFrame([], schema), files.limit(0), L._engine(), L._settings(L.F.lit(False))).count() == 0


def test_preflight_without_a_manifest(spark):
    actions = spark.createDataFrame([("a.metadata.json", "regenerate-sidecar", "missing-sidecar", True)], "path string, action string, reason string, safe boolean")
    issues = spark.createDataFrame([], "path string, severity string, category string, detail string")
    files = spark.createDataFrame([], "path string, bytes long, sha256 string")
    got = repair.preflight(actions, issues, None, files).first()
    assert (got.status, got.block_reason) == ("blocked", "manifest-invalid")


@pytest.mark.parametrize("query", [report_queries.undeclared_operations, report_queries.execution_summary, L.audit_operations, L.audit_summary])
def test_lines_are_collected_as_they_are(spark, sf_dir, query):
    """Digests are made where an order's lines are together, and those of sources are not broadcast."""
    plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    collected = [line for line in plan.splitlines() if "partial_collect_list" in line]
    assert collected and not any("sha2" in line.split("partial_collect_list")[1] for line in collected)
    assert "Broadcast" not in plan
