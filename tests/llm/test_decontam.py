import random
import time

import numpy as np
import pytest

from ledgerframe.llm import decontam
from tests.llm import texts

ITEMS = "item_id long, text string, doc_id long"


def item(k, n=30):
    pick = random.Random(k)
    return [f"t{pick.randrange(10**6)}" for _ in range(n)]


def planted():
    a, b = item(1), item(2)
    filler = item(9, 200)
    docs = {
        1: filler + a + filler,  # whole
        2: a[15:] + filler + a[:15],  # in another order
        3: filler[:50] + [w.upper() + "," for w in a],  # case and punctuation
        4: filler + a[:9] + filler,  # too little
        5: b[:4] + a[:20] + ["x"] + b[:8] + a[20:],
        6: filler,
        7: a[::-1],  # no run in common
    }
    return {i: " ".join(w) for i, w in docs.items()}


def frames(spark, docs):
    rows = [(i, t, "en", "s", 0, "x", 1, "y", "z") for i, t in docs.items()]
    items = [(1, " ".join(item(1)), 5), (2, " ".join(item(2)), 5), (3, "", 5), (4, None, 5), (None, "no id here at all", 5), (6, "exact pair", 5)]
    return texts.frame(spark, rows), spark.createDataFrame(items, ITEMS)


def test_matches(spark):
    docs, items = frames(spark, planted() | {8: None, 9: "", 10: "an Exact pair."})
    got = {(r.doc_id, r.item_id): (round(r.coverage, 3), r.n_tiles, r.longest_tile) for r in decontam.matches(docs, items).collect()}
    assert got == {(1, 1): (1.0, 1, 30), (2, 1): (1.0, 2, 15), (3, 1): (1.0, 1, 30), (5, 1): (1.0, 2, 20), (10, 6): (1.0, 1, 2)}
    left = decontam.without_leaks(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [4, 6, 7, 8, 9]


def test_shards_give_the_same(spark, monkeypatch):
    docs, items = frames(spark, planted())
    want = sorted(map(tuple, decontam.matches(docs, items).collect()))
    monkeypatch.setattr(decontam, "SHARD_BYTES", 100)
    assert sorted(map(tuple, decontam.matches(docs, items).collect())) == want
    assert sorted(r.doc_id for r in decontam.without_leaks(docs, items).collect()) == [4, 6, 7]


def test_empty_sides(spark):
    docs, items = frames(spark, planted())
    assert decontam.matches(docs, items.limit(0)).count() == 0
    assert decontam.matches(texts.frame(spark, []), items).count() == 0
    assert decontam.without_leaks(docs, items.limit(0)).count() == docs.count()


def brute_tiles(p, t, least):
    """Greedy by definition: of all common runs of unmarked words a longest one is marked, again and again; of several
    the first in p, then in t."""
    used_p, used_t, tiles = [False] * len(p), [False] * len(t), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not used_p[i + n] and not used_t[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        used_p[i : i + n] = used_t[j : j + n] = [True] * n
        tiles.append((i, j, n))


@pytest.mark.parametrize("most", [decontam.MOST_RUNS, 3])
def test_tiles_are_those_of_the_definition(monkeypatch, most):
    monkeypatch.setattr(decontam, "MOST_RUNS", most)
    pick = random.Random(4)
    for _ in range(150):
        words, least = pick.choice([1, 2, 3, 5, 9]), pick.choice([1, 2, 3, 4])
        p, t = ([pick.randrange(words) + 5 for _ in range(pick.randrange(0, 40))] for _ in range(2))
        assert decontam.tile(np.array(p, np.uint64), np.array(t, np.uint64), least) == brute_tiles(p, t, least)


def test_equal_words_cost_no_more_than_their_runs():
    began = time.perf_counter()
    assert decontam.tile(np.full(1000, 7, np.uint64), np.full(20_000, 7, np.uint64), 4) == [(0, 0, 1000)]
    assert len(decontam.tile(np.array([1, 2] * 500, np.uint64), np.array([1, 2, 1] * 6000, np.uint64), 4)) == 0
    assert time.perf_counter() - began < 2


def test_matches_equal_brute_force(spark):
    pick = random.Random(12)
    items = [(i, " ".join(pick.choice("abcdefg") for _ in range(pick.randrange(0, 25)))) for i in range(12)]
    docs = []
    for i in range(60):
        words = [pick.choice("abcdefgxyz") for _ in range(pick.randrange(0, 30))]
        for _ in range(pick.randrange(3)):
            own = pick.choice(items)[1].split()
            for _ in range(2):  # two passages of it, in any order
                a, b = pick.randrange(len(own) + 1), pick.randrange(len(words) + 1)
                words[b:b] = own[a : a + pick.randrange(4, 20)]
        docs.append((i, ", ".join(words).upper(), "en", "s", 0, "x", 1, "y", "z"))
    want = []
    for d, text, *_ in docs:
        t = text.lower().replace(",", " ").split()
        for k, item_text in items:
            p = item_text.split()
            if 0 < len(p) < 4:
                if any(t[j : j + len(p)] == p for j in range(len(t))):
                    want.append((d, k, 1.0, 1, len(p)))
            elif p:
                tiles = brute_tiles(p, t, 4)
                if tiles and sum(n for *_, n in tiles) / len(p) >= 0.5:
                    want.append((d, k, sum(n for *_, n in tiles) / len(p), len(tiles), max(n for *_, n in tiles)))
    got = [tuple(r) for r in decontam.matches(texts.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(got) == sorted(want)
    assert len(want) > 15 and any(r[3] > 1 for r in want)
