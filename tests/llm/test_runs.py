"""Periodic runs against a search through all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerframe.llm import queries, runs
from ledgerframe.llm.common import hashed
from tests.llm import texts


def by_trying(words):
    """Runs by every period: stretches in which words a period apart are equal, unless a smaller period gives the same."""
    out = {}
    n = len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(24, 3 * q):
                out.setdefault((start, i - start + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def told(words):
    body = " ".join(words).encode()
    ((lo, hi),) = hashed([body])
    return runs.found_in(body.split(), runs._repeated(lo, hi)) if runs._repeated(lo, hi) else []


def random_words(pick, n, kinds):
    out = []
    while len(out) < n:
        piece = [pick.choice("abcdefgh"[:kinds]) for _ in range(pick.randrange(1, 15))]
        out += piece * pick.choice([1, 1, 2, 3, 5, 9]) + piece[: pick.randrange(len(piece))]
    return out


@pytest.mark.parametrize("kinds", [1, 2, 3, 8])
def test_random_words(kinds):
    pick = random.Random(kinds)
    for _ in range(150):
        words = random_words(pick, pick.randrange(0, 260), kinds)
        assert told(words) == by_trying(words), words
        whole = runs.runs_of(np.array([ord(w) for w in words], np.int64))
        assert whole == by_trying(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=8), st.integers(0, 30), st.lists(st.sampled_from("abc"), max_size=12), st.integers(0, 9), st.integers(1, 40))
def test_nested_runs(a, m, b, n, leaves):
    words = ((a * m) + b) * n + a
    runs.LEAVES, kept = leaves, runs.LEAVES
    try:
        assert told(words) == by_trying(words)
    finally:
        runs.LEAVES = kept


def test_long_texts():
    pick = random.Random(4)
    body = [f"w{pick.randrange(40)}" for _ in range(700)]
    words = body * 30 + ["x"] * 9_000 + ["y"] + ["a", "b"] * 5_000
    assert told(words) == [(0, 21_000, 700), (21_000, 9_000, 1), (30_001, 10_000, 2)]


def expected(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = by_trying(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = None
    for s, n, q in found:
        if best is None or n * best[2] > best[1] * q or (n * best[2] == best[1] * q and (s, q) < (best[0], best[2])):
            best = (s, n, q)
    best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_query(spark, tmp_path):
    pick = random.Random(8)
    planted = [k for k in range(2_000) if zlib.crc32(str(k).encode()) % 10 == 0][:25]
    rows = [(k, pick.choice([" ", "\n", "\x0b\t"]).join(f"v{pick.randrange(60)}" for _ in range(pick.choice([0, 1, 5, 23, 24, 25, 80, 300])))) for k in [*range(30), *planted, *planted]]
    rows += [(k, None) for k in (1, planted[0])] + [(None, "a b " * 40), (7, "a " * 24), (7, "a " * 23), (8, "é\x85 ü " * 30), (planted[1], " ".join(random_words(pick, 200, 2)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, queries.op11_periodic_runs(spark, str(tmp_path)).collect()))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    from pyspark.sql import Row

    assert got == sorted(str(Row(**dict(zip(names, (k, *expected(k, t)), strict=True)))) for k, t in rows)


def test_columns_and_empty_tables(spark):
    docs = texts.frame(spark).selectExpr("*", "1 as RUNS", "2 as value")
    out = runs.detected(docs)
    assert out.columns == [c for c in docs.columns if c != "RUNS"] + ["runs", "collapsed"]
    for r in out.collect():
        words = (r.text or "").split()
        assert [tuple(x) for x in r.runs] == by_trying(words) and r.value == 2
    assert runs.detected(docs.limit(0)).count() == 0
