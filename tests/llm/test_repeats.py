import hashlib
import random

import numpy as np
import pytest

from ledgerframe.llm import repeats, sketch, substring_dedup, suffix_dedup
from ledgerframe.llm.common import hashed, rolling_least, windows
from tests.llm import texts


def words_of(text):
    return (text or "").encode().split()


def brute(data, length):
    """Masks of the words covered by windows that a smaller id also holds."""
    first = {}
    for i, t in data:
        w = words_of(t)
        for p in range(len(w) - length + 1 if i is not None else 0):
            k = tuple(w[p : p + length])
            first[k] = min(i, first.get(k, i))
    out = []
    for i, t in data:
        w = words_of(t)
        gone = [False] * len(w)
        for p in range(len(w) - length + 1 if i is not None else 0):
            if first[tuple(w[p : p + length])] < i:
                gone[p : p + length] = [True] * length
        out.append((i, w, gone))
    return out


def test_substring_dedup_equals_brute_force(spark):
    data = [(r[0], r[1]) for r in texts.rows()]
    got = substring_dedup.digests(texts.frame(spark)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = [(i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, gone in zip(w, g) if not gone)).hexdigest()) for i, w, g in brute(data, 13)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(x[2] for x in want) > 500


def test_substring_dedup_keeps_columns_and_takes_empty_input(spark):
    out = substring_dedup.digests(texts.frame(spark, []))
    assert out.columns == [*texts.frame(spark, []).columns, "n_words", "n_removed", "kept_sha256"]
    assert out.count() == 0


@pytest.mark.parametrize("length", [50, 20])
def test_suffix_spans_equal_brute_force(spark, length):
    data = [(r[0], r[1]) for r in texts.rows()]
    got = {(r.doc_id, p) for r in suffix_dedup.spans(texts.frame(spark), length).collect() for p in range(r.first_word, r.first_word + r.n_words)}
    # rows of one id with other texts: places of either
    want = {(i, p) for i, _, g in brute(data, length) for p, gone in enumerate(g) if gone}
    assert got == want and want


@pytest.mark.parametrize(("hot", "bucket"), [(2, 24_000_000), (20_000, 3_000), (4, 700)])
def test_hot_cores_and_several_buckets_give_the_same(spark, monkeypatch, hot, bucket):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(repeats, "BUCKET_TEXT", bucket)
    monkeypatch.setattr(repeats, "SPREAD", 4)
    data = texts.rows(seed=19)
    got = {(r.doc_id, p) for r in suffix_dedup.spans(texts.frame(spark, data)).collect() for p in range(r.first_word, r.first_word + r.n_words)}
    assert got == {(i, p) for i, _, g in brute([(r[0], r[1]) for r in data], 50) for p, gone in enumerate(g) if gone}
    removed = sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.digests(texts.frame(spark, data)).collect())
    assert removed == sorted((i or -1, sum(g)) for i, _, g in brute([(r[0], r[1]) for r in data], 13))


def test_runs_found_by_the_suffix_array():
    pick = random.Random(8)
    for _ in range(60):
        length, docs = 10, []
        for d in range(pick.randrange(2, 7)):
            docs.append([pick.randrange(3) for _ in range(pick.randrange(10, 40))])
        suffixes = []  # (doc, words, words before the suffix), cut as a retained suffix is
        for d, w in enumerate(docs):
            p = pick.randrange(len(w) - 4)
            first, last = max(0, p - 5), min(p, len(w) - length)
            if first <= last:
                suffixes.append((d, w[first : last + length], p - first))
        if not suffixes:
            continue
        words = np.array([x + 1 for _, w, _ in suffixes for x in w], np.uint64)
        n, left, doc = (np.array(x, np.int64) for x in ([len(w) for _, w, _ in suffixes], [b for *_, b in suffixes], [d for d, *_ in suffixes]))
        got = set(zip(*(x.tolist() for x in suffix_dedup.repeats_of(words, n, left, doc, length)), strict=True))
        runs = [(i, b, tuple(w[b - k : b - k + length]), k) for i, (_, w, b) in enumerate(suffixes) for k in range(6) if k <= b and len(w) - b >= length - k]
        want = {(i, k) for i, _, run, k in runs if any(r == run and kk == k and suffixes[j][0] < suffixes[i][0] for j, _, r, kk in runs)}
        assert got == want


def test_columns_with_the_operators_own_names_stay(spark):
    names = ["__text", "row_key", "doc", "own", "late_at", "new_0", "body", "N_WORDS"]
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, passage, *"abcdefgh"), (2, f"x {passage}", *"ijklmnop")], f"doc_id long, text string, {', '.join(f'{c} string' for c in names)}")
    cut = {r.doc_id: tuple(r) for r in suffix_dedup.without_repeats(docs).collect()}
    assert cut == {1: (1, passage, *"abcdefgh"), 2: (2, "x", *"ijklmnop")}
    out = substring_dedup.digests(docs)
    assert out.columns == ["doc_id", "text", *names[:-1], "n_words", "n_removed", "kept_sha256"]
    assert {r.doc_id: tuple(r)[:-3] for r in out.collect()} == {1: (1, passage, *"abcdefg"), 2: (2, f"x {passage}", *"ijklmno")}


def test_suffix_cut_keeps_the_rest_as_it_is(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    data = [(1, f"a  b {passage}\tc\n"), (2, f"  x\ny {passage}\n\nz  w "), (3, passage), (4, None), (5, "short"), (6, "")]
    rows = [(i, t, "en", "s", 0, "x", 1, "y", "z") for i, t in data]
    got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(texts.frame(spark, rows)).collect()}
    assert got == {1: data[0][1], 2: "  x\ny z  w ", 3: "", 4: None, 5: "short", 6: ""}


def test_selected_is_the_same_for_equal_runs():
    pick = random.Random(3)
    run = [b"%d" % pick.randrange(50) for _ in range(40)]
    one, two = [b"a"] * 7 + run + [b"b"] * 9, [b"%d" % i for i in range(31)] + run
    found = []
    for words, at in ((one, 7), (two, 31)):
        lo, hi = next(hashed([b" ".join(words)]))
        found.append(suffix_dedup.selected(windows(lo, hi, 20)[0], 40)[at] - at)
    assert found[0] == found[1]


def test_rolling_least():
    x = np.array([5, 3, 9, 1, 7, 7, 2], np.uint64)
    for width in range(1, 8):
        assert rolling_least(x, width).tolist() == [int(x[i : i + width].min()) for i in range(len(x) - width + 1)]


def test_hashed_words_match_the_rule():
    bodies = [b"", b"  ", b"a\x0bb\x1cc", b"Ab ab aB", "é x".encode(), b"q" * 70 + b" " + b"Q" * 70]
    for lower in (False, True):
        for body, (lo, hi) in zip(bodies, hashed(bodies, lower), strict=True):
            words = (body.lower() if lower else body).split()
            assert len(lo) == len(hi) == len(words)
            assert len(set(lo.tolist())) == len(set(words))


def test_count_min_never_underestimates(spark):
    data = texts.rows()
    docs = texts.frame(spark, data).select("text").filter("text is not null")

    def keys(batch):
        for lo, hi in hashed(b.as_py().encode() for b in batch.column(0)):
            yield lo, hi

    counted = sketch.merged(docs, keys, 16, 2)
    seen = {}
    for r in data:
        for w in words_of(r[1]):
            seen[w] = seen.get(w, 0) + 1
    lo, hi = next(hashed([b" ".join(seen)]))
    estimate = counted.repeated(lo, hi)
    assert all(e for e, n in zip(estimate, seen.values(), strict=True) if n > 1)
    assert sum(estimate) < len(seen)


def test_long_runs_are_measured_in_two_bytes(spark):
    """Runs of more words than a byte counts, before and after the word they share."""
    words = [f"q{i}" for i in range(1_500)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[100:1_300], "y"])), (3, " ".join(words[:599]))]
    found = {tuple(r) for r in suffix_dedup.spans(spark.createDataFrame(rows, "doc_id long, text string"), length=600).collect()}
    assert found == {(2, 1, 1_200)}


def test_a_document_in_many_buckets_is_one_row(spark, monkeypatch):
    """However many buckets its windows fall into: what buckets find is packed by parts of the documents."""
    monkeypatch.setattr(repeats, "BUCKET_TEXT", 500)
    monkeypatch.setattr(repeats, "LEAST_GROUPS", 3)
    phrases = [" ".join(f"p{k}w{i}" for i in range(14)) for k in range(40)]
    rows = [(d, " - ".join(f"{p} d{d}x{k}" for k, p in enumerate(phrases))) for d in range(6)]
    late = substring_dedup.repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc for r in late) == [1, 2, 3, 4, 5]
    want = {16 * k + i for k in range(40) for i in (0, 1)} | {16 * k + 15 for k in range(39)}  # the last ones begin with the dash
    assert all(set(np.frombuffer(b"".join(r.late_at), "<u4").tolist()) == want for r in late)
