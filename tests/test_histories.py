"""Histories of sessions and chains of bindings, odd rows and ties."""

from ledgerframe.operators import histories
from ledgerframe.plans import executor, history_queries


def test_the_table_is_that_of_the_single_session(spark):
    states = list(histories.TRANSITIONS)
    pairs = {(a, b) for a in states for b in states}
    fine = {tuple(r) for r in histories.allowed(spark).collect()}
    for a, b in pairs:
        try:
            executor.next_state(a, b)
            assert (a, b) in fine
        except executor.OutputError:
            assert (a, b) not in fine


def test_first_illegal(spark):
    rows = [("a", 1, "open"), ("a", 2, "complete"), ("b", 2, "open"), ("b", 1, "complete"), ("c", 1, "open"), ("c", 1, "complete"), ("c", 2, "open"), ("c", 3, "open"), ("d", 1, None), ("d", 2, "open"), (None, 1, "open")]
    got = {r.s: tuple(r)[1:] for r in histories.first_illegal(spark.createDataFrame([(*r, 1, 2) for r in rows], "s string, t int, state string, place int, before int"), ["s"], ["t"]).collect()}
    assert got == {
        "a": (2, "complete", 0, None, None, None), "b": (2, "open", 2, 0, None, "complete"), "c": (4, "open", 2, 0, None, "complete"), "d": (2, "open", 2, 0, None, None), None: (1, "open", 0, None, None, None),
    }
    assert histories.first_illegal(spark.createDataFrame([], "s string, t int, state string"), ["s"], ["t"]).count() == 0


def test_chains(spark):
    full = {"preflight": "f", "approval": "a", "plan": "p", "manifest": "m"}
    below = lambda k: {x: full[x] for x in histories.CHAIN[histories.CHAIN.index(k) + 1 :]}
    good = [("receipt", "r", full), *((k, full[k], below(k)) for k in full)]
    cases = {
        "good": (good, ("manifest", None)),
        "none": ([("receipt", "r", None)], ("receipt", "preflight: missing")),
        "plan": ([g if g[0] != "plan" else ("plan", "p", {"manifest": "x"}) for g in good], ("approval", "plan: mismatch")),
        "two": ([*good, good[2]], ("preflight", "approval: several")),
        "null": ([(k, None if k == "manifest" else s, b) for k, s, b in good], ("plan", "manifest: missing")),
        "other kind": ([("manifest" if k == "plan" else k, s, b) for k, s, b in good], ("approval", "plan: missing")),
    }
    rows = [(name, *r, 1) for name, (reports, _) in cases.items() for r in reports] + [("no receipt", "plan", "p", {}, 1)]
    got = {r.package: (r.reached, r.broken) for r in histories.chains(spark.createDataFrame(rows, "package string, kind string, sha256 string, bindings map<string,string>, n int")).collect()}
    assert got == {k: v for k, (_, v) in cases.items()}
    assert histories.chains(spark.createDataFrame([], "package string, kind string, sha256 string, bindings map<string,string>")).count() == 0


def test_chains_of_odd_reports(spark):
    full = {"preflight": "f", "approval": "a", "plan": "p", "manifest": "m"}
    below = lambda k: {x: full[x] for x in histories.CHAIN[histories.CHAIN.index(k) + 1 :]}
    reports = [(k, full[k], below(k)) for k in full]
    rows = [("x", "receipt", "r", full), ("x", "receipt", "r", full), ("x", "receipt", "r", {**full, "plan": None}), ("x", "receipt", "s", {**full, "manifest": "n"}), (None, "receipt", "r", full), ("y", "receipt", "r", full)]
    rows += [("x", *r) for r in reports] + [(None, *r) for r in reports] + [("y", k, s, None if k == "plan" else b) for k, s, b in reports]
    got = histories.chains(spark.createDataFrame(rows, "package string, kind string, sha256 string, bindings map<string,string>")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        ("x", "r", "manifest", None), ("x", "r", "manifest", None), ("x", "r", "receipt", "preflight: mismatch"), ("x", "s", "receipt", "preflight: mismatch"), (None, "r", "receipt", "preflight: missing"), ("y", "r", "approval", "plan: mismatch"),
    ], key=str)


def test_no_reports_are_broadcast(spark, sf_dir):
    """Digests are made of narrow columns, so Spark takes their relation for a small one."""
    plan = history_queries.binding_chains(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning") <= 5
