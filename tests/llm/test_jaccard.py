import itertools

import pytest

from ledgerframe.llm import components, jaccard_join
from tests.llm import texts


def brute(data, k, percent):
    sets, parent = [], {}
    for i, t in data:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))) if w else frozenset()))
        parent[i] = i

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else root(i)) for i, s in sets]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, k, percent):
    data = texts.rows()
    got = [tuple(r) for r in jaccard_join.components(texts.frame(spark), k, percent).collect()]
    want = brute([(r[0], r[1]) for r in data], k, percent)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(i != c for i, _, c in want if i is not None) > 10


def test_several_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 4)
    monkeypatch.setattr(jaccard_join, "SMALL", 10)
    data = texts.rows(seed=11, n=90)
    got = [tuple(r) for r in jaccard_join.components(texts.frame(spark, data)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute([(r[0], r[1]) for r in data], 4, 85)))


def test_kept_is_one_of_each_group(spark):
    docs = texts.frame(spark)
    got = jaccard_join.kept(docs, 4, 85)
    assert got.columns == docs.columns
    smallest = {c for i, _, c in brute([(r[0], r[1]) for r in texts.rows()], 4, 85) if i is not None}
    assert {r.doc_id for r in got.collect()} == smallest | {None}


def test_empty(spark):
    assert jaccard_join.components(texts.frame(spark, [])).count() == 0


def test_roots_of_long_paths_and_loops(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 100), (70, 90), (90, 80), (90, 80), (None, 5)]
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {80: 70, 90: 70}
