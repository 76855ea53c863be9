import random

import numpy as np
from pyspark.sql import functions as F

from ledgerframe.llm import ann, chat, warc

CHAT = "conv_id long, turn long, role string, text string, place string, chunk int"


def brute_chat(rows):
    seen = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            seen.setdefault(c, set()).add((t is not None, t or 0, r or "", x or ""))
    convs = {c: tuple((r, x) for _, _, r, x in sorted(v)) for c, v in seen.items()}
    out = {}
    for c, v in sorted(convs.items()):
        if not any(len(o) > len(v) and o[: len(v)] == v for o in convs.values()):
            out.setdefault(v, []).append(c)
    return {(cs[0], len(v), len(cs), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v)) for v, cs in out.items()}


def test_chat_equals_brute_force(spark):
    pick, rows = random.Random(1), []
    stem = [("user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(600)]
    for c in range(60):
        own = stem[: pick.randrange(1, 7)] + [("user", f"u{pick.randrange(4)}")] * pick.randrange(0, 2)
        rows += [(c, t, r, x, "p", 1) for t, (r, x) in enumerate(own)]
    rows += [(100, t, r, x, "p", 1) for t, (r, x) in enumerate(stem)] + [(101, t, r, x, "p", 1) for t, (r, x) in enumerate(stem[:599])]
    rows += [(102, 5, None, None, "p", 1), (102, None, "user", "first", "p", 1), (102, 5, "user", "b", "p", 1), (102, 5, "user", "a", "p", 1), (None, 0, "user", "x", "p", 1), rows[0], rows[0]]
    got = chat.formatted(spark.createDataFrame(rows, CHAT))
    whole = {}
    for r in got.collect():
        whole.setdefault((r.conv_id, r.n_turns, r.n_logged), {})[r.part] = r.text
    assert {(*k, "".join(v[p] for p in sorted(v))) for k, v in whole.items()} == brute_chat(rows)
    assert max(len(v) for v in whole.values()) == 3
    assert chat.formatted(spark.createDataFrame([], CHAT)).count() == 0


def test_canonical_urls(spark):
    same = {
        "HTTP://Www.Ex.com:80/a?b=2&a=1&utm_x=3#f": "www.ex.com/a?a=1&b=2", "https://www.ex.com:443/a?a=1&b=2": "www.ex.com/a?a=1&b=2", "http://ex.com": "ex.com/", "http://ex.com?": "ex.com/",
        "https://ex.com:80/": "ex.com:80/", " no url ": "no url", "": "", "a#b": "a",
    }
    got = spark.createDataFrame([(u,) for u in same], "u string").select("u", warc.canonical(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in got} == same


RECORDS = "record_id long, url string, at long, status int, headers map<string,string>, payload string, seg int"


def brute_warc(rows, canonical):
    out = []
    for i, u, at, s, h, _, _ in rows:
        if s != 304:
            continue
        h = {k.lower(): v for k, v in (h or {}).items()}
        cand = [r for r in rows if r[3] == 200 and u is not None and at is not None and r[1] is not None and r[2] is not None and canonical[r[1]] == canonical[u] and r[2] < at]
        if not cand:
            out.append((i, None, "unresolved", None, None))
            continue
        r = max(cand, key=lambda r: (r[2], r[0]))
        o = {k.lower(): v for k, v in (r[4] or {}).items()}
        strip = lambda t: t if t is None else t.removeprefix("W/")
        agree = None
        if h.get("etag") is not None:
            agree = strip(h["etag"]) == strip(o.get("etag"))
        elif h.get("last-modified") is not None:
            agree = h["last-modified"] == o.get("last-modified")
        status = "unverified" if agree is None else "resolved" if agree else "mismatch"
        fine = status == "resolved"
        out.append((i, r[0], status, tuple(sorted((o | {k: v for k, v in h.items() if k in warc.PERMITTED}).items())) if fine else None, r[5] if fine else None))
    return sorted(out, key=str)


def test_revisits_equal_brute_force(spark):
    pick, rows = random.Random(6), []
    for i in range(400):
        url = pick.choice(["http://Hot.com/a", "https://hot.com/a#x", "http://hot.com:80/a", f"http://h{pick.randrange(20)}.com/p", None if pick.random() < 0.1 else "x"])
        tag = pick.choice(['"1"', 'W/"1"', '"2"', None])
        headers = {"ETag": tag, "Date": f"d{i}", "Server": f"s{i}"} if tag else pick.choice([None, {}, {"Last-Modified": pick.choice("ab"), "Vary": "v"}, {"Date": "d"}, {"ETAG": '"1"', "etag": '"2"', "ETag": '"1"'}])
        rows.append((i, url, pick.choice([None, *range(60)]), pick.choice([200, 200, 304, 304, 404]), headers, f"p{i}", 3))
    rows += rows[:5]
    frame = spark.createDataFrame(rows, RECORDS)
    canonical = {r.url: r.c for r in frame.select("url", warc.canonical(F.col("url")).alias("c")).distinct().collect()}
    got = [(r.record_id, r.response_id, r.status, tuple(sorted(r.headers.items())) if r.headers is not None else None, r.payload) for r in warc.resolved(frame).collect()]
    assert sorted(got, key=str) == brute_warc(rows, canonical)
    assert {r[2] for r in got} == {"resolved", "mismatch", "unverified", "unresolved"}
    assert warc.resolved(frame.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, k1 int, e string"


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:600] = x[100]  # a third are copies
    rows = [(i, x[i].tolist(), 0, 1, "c") for i in range(1500)]
    rows += [(1500, None, 0, 1, "c"), (1550, [0.0] * 16, 0, 1, "c"), (1600, [1.0] * 15 + [float("nan")], 0, 1, "c"), (1650, [1.0] * 15 + [None], 0, 1, "c"), (1700, [1.0] * 3, 0, 1, "c"), (None, x[1].tolist(), 0, 1, "c"), rows[50]]
    got = ann.search(spark.createDataFrame(rows, VECTORS)).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 50))
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hits = 0
    for q, found in by.items():
        score = y @ y[q]
        score[q] = -2
        score = np.where(score > 1 - 1e-12, 1.0, score)
        want = np.lexsort((np.arange(1500), -score))[:5]
        found.sort()
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - y[v] @ y[q]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(want.tolist()))
        if 100 <= q < 600:
            assert [v for _, v, _ in found] == [v for v in range(100, 107) if v != q][:5]
    assert hits / (5 * len(by)) >= 0.9


def test_neighbours_of_few_or_no_vectors(spark):
    few = [(0, [1.0, 0.0], 0, 1, "c"), (3, [2.0, 0.0], 0, 1, "c"), (2, [0.0, 1.0], 0, 1, "c")]
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(spark.createDataFrame(few, VECTORS)).collect()]
    assert sorted(got) == [(0, 1, 3, 1.0), (0, 2, 2, 0.0)]
    assert ann.search(spark.createDataFrame([], VECTORS)).count() == 0


def exact(x, ids, every=50, k=5):
    """The k nearest of each query, from distinct vectors."""
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = y @ y[i]
        score[i] = -2
        out[int(ids[i])] = set(ids[np.argsort(-score, kind="stable")[:k]].tolist())
    return out


def recall(found, want):
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(len(got[q] & w) for q, w in want.items()) / sum(map(len, want.values()))


def test_clustered_vectors_are_found_in_few_leaves_and_leaves_deepen(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(60, 24))[rng.integers(0, 60, 6000)] + 0.3 * rng.normal(size=(6000, 24))).astype(np.float32)
    frame, want = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), exact(x.astype(float), np.arange(6000))
    one: dict = {}
    assert recall(ann.search(frame, report=one).collect(), want) >= 0.9
    assert one["scored"] < 0.15
    monkeypatch.setattr(ann, "SAMPLE", 400)
    monkeypatch.setattr(ann, "LEAF_VECTORS", 100)
    two: dict = {}
    assert recall(ann.search(frame, report=two).collect(), want) >= 0.9
    assert two["leaves"] > 60 and two["scored"] < 0.15


def test_recall_and_visits_of_all_queries(spark, capsys):
    """The vectors of the test data are noise without structure, the worst case: most of what a leaf keeps out is luck."""
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.select("vec_id", "embedding").collect()
    report: dict = {}
    found = ann.search(frame, report=report).collect()
    reached = recall(found, exact(np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])))
    with capsys.disabled():
        print(f"\nnearest neighbours at sf0.1: recall {reached:.3f}, {report['visits']} of {report['leaves']} leaves visited, {report['scored']:.2f} of the vectors scored")
    assert reached >= 0.9
    assert report["scored"] < 0.75
