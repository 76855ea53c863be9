"""Readers of JSON as columns: kinds of values, odd texts, and what decides first."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerframe.functions import keys
from ledgerframe.functions import variants as V
from ledgerframe.operators import readers
from ledgerframe.plans import reader_queries as Q
from ledgerframe.plans import reports as R

TEXTS = ["", " ", "{", "{}", "[]", "null", "1", "1.0", "1e0", "true", '"x"', '""', "-1", "1 2", "{} {}", "{}]", "[1],", "1,2", '{"a":1,"a":2}', "NaN", "12345678901234567890", "1.5", '"\\u0000"', None, ' {"a": [1, null]} \n', "'x'", "{a:1}", "﻿{}", "[" * 300 + "]" * 300]


def test_kinds_of_values(spark):
    v = V.parsed(F.col("t"))
    tests = {n: getattr(V, n)(v) for n in ("text", "flag", "count", "loosely_one", "one", "exactly_one", "is_object")}
    got = {r.t: r for r in spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", v.isNotNull().alias("json"), *(c.alias(n) for n, c in tests.items())).collect()}
    loads = {}
    for t in TEXTS:
        try:
            loads[t] = json.loads(t, parse_constant=lambda c: 1 / 0, object_pairs_hook=lambda p: dict(p) if len(dict(p)) == len(p) else 1 / 0) if t is not None else ...
        except (ValueError, ZeroDivisionError):
            loads[t] = ...
    for t, r in got.items():
        value = loads[t]
        assert r.json == (value is not ...), t
        if value is ...:
            continue
        assert (r.text, r.flag, r["count"], r.is_object) == (R.text(value), R.flag(value), R.count(value), isinstance(value, dict)), t
        assert (r.loosely_one, r.one, r.exactly_one) == (R.loosely_one(value), R.one(value), R.exactly_one(value)), t


def sidecar(**changes):
    p = {
        "schema_version": 1, "report_type": readers.SIDECAR_TYPE, "engine": {"name": "p", "version": "1"}, "document": {"input_path": "a.pdf", "output_path": "a.md", "status": "succeeded"},
        "artifact": {"bytes": 1, "sha256": "0" * 64}, "source": {"bytes": 2, "sha256": "1" * 64}, "settings": {"table_structure": True, "normalization_profile": None, "artifacts_path_configured": False},
    }
    for path, value in changes.items():
        *into, last = path.split("__")
        at = p
        for k in into:
            at = at[k]
        at[last] = value
    return json.dumps(p)


SIDECARS = {
    sidecar(): "", sidecar(more=[1]): "", sidecar(schema_version=1.0): "", sidecar(schema_version=True): "", sidecar(settings__normalization_profile="x"): "", sidecar(artifact__bytes=10**25): "",
    sidecar() + "x": "invalid-json", "[" + sidecar() + "]": "invalid-schema", sidecar(schema_version=2): "unsupported-schema", sidecar(schema_version="1"): "unsupported-schema", sidecar(report_type="x"): "invalid-schema",
    sidecar(engine=[]): "invalid-schema", sidecar(document__input_path="/a"): "outside-package-root", sidecar(document__output_path="a/../b"): "outside-package-root", sidecar(document__output_path="."): "outside-package-root",
    sidecar(document__input_path=None): "invalid-schema", sidecar(document__status="failed"): "invalid-schema", sidecar(artifact__bytes=True): "invalid-schema", sidecar(artifact__bytes=-1): "invalid-schema", sidecar(source__bytes=1.0): "invalid-schema",
    sidecar(source__sha256="A" * 64): "invalid-schema", sidecar(engine__name="q"): "invalid-schema", sidecar(engine__version=""): "invalid-schema", sidecar(settings__table_structure=1): "invalid-schema", sidecar(settings__normalization_profile=1): "invalid-schema",
    sidecar(document__input_path="\\", engine__name="q"): "outside-package-root", sidecar(document__input_path="/" + "a/" * 50_000): "outside-package-root",
}


def test_sidecars(spark):
    rows = [(str(i), t, 1) for i, t in enumerate(SIDECARS)] + [("null", None, 1)]
    got = {r.path: r for r in readers.sidecars(spark.createDataFrame(rows, "path string, content string, category int"), "p").collect()}
    assert {k: got[str(i)].category for i, k in enumerate(SIDECARS)} == SIDECARS
    assert got["null"].category == "invalid-json" and got["null"].engine is None
    sound = got["0"]
    assert (sound.input_path, sound.status, tuple(sound.source), tuple(sound.engine), tuple(sound.settings)) == ("a.pdf", "succeeded", (2, "1" * 64), ("p", "1"), (True, None, False))
    assert readers.sidecars(spark.createDataFrame([], "path string, content string"), "p").count() == 0


def test_manifests(spark):
    head = lambda **c: json.dumps({"schema_version": 1, "report_type": readers.MANIFEST_TYPE, "engine": {"name": "p", "version": ""}, "settings": {"table_structure": True, "artifacts_path_configured": True}} | c)
    line = lambda status="succeeded", path="a.md", n=1: json.dumps({"input": {"path": "a.pdf", "bytes": 1, "sha256": "0" * 64}, "output": {"path": path, "bytes": n, "sha256": "0" * 64}, "status": status})
    heads = [("ok", head()), ("empty", head()), ("head", head(schema_version=2)), ("late", head()), ("first", head()), ("tie", head()), ("failed", head()), ("none", None)]
    lines = [("ok", 0, line()), ("ok", 1, line("skipped")), ("head", 0, "x"), ("late", 5, line(path="../x")), ("late", 7, "x"), ("late", 3, line()), ("first", 1, "7"), ("first", 2, line(path="../x")), ("tie", 1, line(path="/x")), ("tie", 1, "x"), ("failed", 1, line("failed", n=None)), ("lost", 1, line())]
    found, items = readers.manifests(spark.createDataFrame(heads, "manifest string, content string"), spark.createDataFrame(lines, "manifest string, seq long, content string"), "p")
    assert {r.manifest: tuple(r)[1:] for r in found.collect()} == {
        "ok": ("", None, 2), "empty": ("", None, 0), "head": ("unsupported-schema", None, 1), "late": ("outside-package-root", 5, 3), "first": ("invalid-schema", 1, 2), "tie": ("invalid-json", 1, 2), "failed": ("", None, 1), "none": ("invalid-json", None, 0),
    }
    assert sorted((r.manifest, r.seq, r.status) for r in items.collect()) == [("failed", 1, "failed"), ("ok", 0, "succeeded"), ("ok", 1, "skipped")]


FAMILY = {"plan": R.PLAN, "approval": R.APPROVAL, "preflight": R.PREFLIGHT, "execution": R.EXECUTION, "cleanup-audit": R.CLEANUP_AUDIT, "cleanup-plan": R.CLEANUP_PLAN, "cleanup-approval": R.CLEANUP_APPROVAL}


def judged(family, content):
    try:
        FAMILY[family].parse(content.encode())
    except R.ReportError as e:
        return {"no JSON": "json", "report type or version": "type", "fields": "fields"}.get(str(e), "rule")
    return ""


def test_reports_of_the_tables_are_judged_as_the_single_reader_does(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").dropDuplicates(["l_orderkey", "l_linenumber"])
    texts = Q.report_texts(spark.read.parquet(f"{sf_dir}/orders.parquet"), lines).checkpoint()
    got = readers.reports(texts.withColumn("text", F.col("content")), R.PRODUCER).select(F.col("report").alias("r"), "family", "issue", F.col("text").alias("content")).collect()
    assert {(r.r, r.issue) for r in got if r.family in FAMILY} == {(r.r, judged(r.family, r.content)) for r in got if r.family in FAMILY}
    assert {r.issue for r in got} >= {"", "rule", "fields", "type", "json", "family"}


CLEANED = {"action": "delete-backup-session", "reason_category": "explicit-retention-release", "session": "s", "session_manifest_sha256": "0" * 64, "tree_sha256": "0" * 64, "backup_files": 1, "backup_bytes": 2, "eligible": True}
BLOCKED = CLEANED | {"session": "t", "session_manifest_sha256": None, "tree_sha256": None, "backup_files": 0, "backup_bytes": 0, "eligible": False}


@pytest.mark.parametrize(
    ("family", "body"),
    [
        ("cleanup-plan", {"actions": [CLEANED, BLOCKED]}), ("cleanup-plan", {"actions": [BLOCKED, CLEANED]}), ("cleanup-plan", {"actions": [CLEANED, CLEANED]}), ("cleanup-plan", {"actions": []}), ("cleanup-plan", {"actions": [BLOCKED | {"backup_files": 1}]}),
        ("cleanup-plan", {"actions": [CLEANED | {"session": "É"}, BLOCKED | {"session": "éA"}]}), ("cleanup-plan", {"actions": [CLEANED | {"session": "É"}, BLOCKED | {"session": "é"}]}), ("cleanup-plan", {"actions": [CLEANED | {"session": ".."}]}),
        ("cleanup-approval", {"approved_actions": [CLEANED]}), ("cleanup-approval", {"approved_actions": [BLOCKED]}), ("cleanup-approval", {"approved_actions": None}),
    ],
)
def test_cleanup_reports(spark, family, body):
    actions = body.get("actions") or []
    n, fit = len(actions), sum(a["eligible"] for a in actions)
    p = {"report_type": readers.report_type(family, R.PRODUCER), "schema_version": 1, "inventory": {"sha256": "0" * 64, "schema_version": 1}, "plan": {"sha256": "0" * 64, "schema_version": 1}, "policy": {"mode": "explicit-sessions"}, "scope": {"mode": "all-planned"}, "summary": {"requested": n, "planned": fit, "blocked": n - fit}} | body
    content = json.dumps(p)
    assert readers.reports(spark.createDataFrame([(family, content)], "family string, content string"), R.PRODUCER).first().issue == judged(family, content)


def test_keys_of_arrays(spark):
    rows = [(["A", "b"],), (["É", None, "ß"],), ([],), (None,)]
    got = [r.k for r in spark.createDataFrame(rows, "v array<string>").select(keys.path_keys(F.col("v")).alias("k")).collect()]
    assert got == [["a", "b"], ["é", None, "ss"], [], None]


def test_converter_as_a_table_function(spark):
    """Texts, warnings and errors as rows; a converter that cannot be built fails every document."""
    from ledgerframe.operators import convert

    def convert_one(content):
        if content == b"bad":
            raise convert.ConverterError("x")
        return content.decode() if content == b"plain" else (content.decode().upper(), ["first", "second"])

    docs = spark.createDataFrame([(1, b"plain"), (2, b"more"), (3, b"bad"), (4, None)], "i int, content binary")
    tell = lambda factory: sorted(map(tuple, docs.lateralJoin(convert.table_function(factory)(F.col("content").outer())).select("i", "kind", "seq", "value").collect()))
    assert tell(lambda: convert_one) == [(1, "text", 0, "plain"), (2, "text", 0, "MORE"), (2, "warning", 0, "first"), (2, "warning", 1, "second"), (3, "error", 0, "ConverterError"), (4, "error", 0, "InputError")]
    assert tell(lambda: 1 / 0) == [(i, "error", 0, "ZeroDivisionError") for i in (1, 2, 3, 4)]


def test_reports_are_parsed_once_and_taken_apart_at_once(spark):
    """Of every family all fields come out in one cast: kinds are asked of single values only."""
    rows = spark.createDataFrame([("plan", "{}")], "family string, content string")
    plan = readers.reports(rows, "p")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("variant_get") <= 350
    shape = {"a": {"b": V.digest, "c": V.maybe(V.count)}, "d": V.every({"e": V.text, "f": {"g": V.flag}})}
    frame = spark.createDataFrame([(json.dumps(x),) for x in ({"a": {"b": "0" * 64, "c": None}, "d": [{"e": "x", "f": {"g": True}}]}, {"a": {"b": "0" * 64}, "d": []}, {"a": {"b": "0" * 64}, "d": [7]}, {"a": {"b": "0" * 64}, "d": {}}, {"a": [], "d": []}, [1])], "t string")
    found = frame.select(V.fits(F.parse_json("t"), shape).alias("x"))
    assert [r.x for r in found.collect()] == [True, True, False, False, False, False]
    assert found._jdf.queryExecution().analyzed().toString().count("variant_get") == 5  # what is named, at once, and four values
