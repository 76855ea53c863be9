import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import linear, quality, toxicity
from tests.llm import texts

LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=400):
    pick = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(pick.choice("abcdefgh") for _ in range(pick.randrange(2, 8))) for _ in range(pick.randrange(20, 200))]
        toxic, bad = int(pick.random() < 0.3), int(pick.random() < 0.3)
        for _ in range(3 * toxic):
            words[pick.randrange(len(words))] = pick.choice(["zzworst", "zzawful"])
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        docs.append((i, text, "en", f"s{i % 3}", len(text), "x", 1, "y", "z"))
        if i % 2 == 0:
            labels.append((i, 1 - bad, toxic, "clash"))
    return docs, labels


@pytest.fixture(scope="module")
def made(spark):
    docs, labels = corpus()
    return docs, labels, texts.frame(spark, docs), spark.createDataFrame(labels, LABELS)


def test_toxicity_of_held_out_rows(made):
    docs, labels, frame, known = made
    got = {r.doc_id: r for r in toxicity.scored(frame, known).collect()}
    assert len(got) == len(docs)
    held = [(got[i].predicted, t) for i, _, t, _ in labels if got[i].held_out]
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == r.held_out and (r.score >= 0.5) == r.predicted for i, r in got.items())
    assert sum(p == t for p, t in held) / len(held) >= 0.9


def test_held_out_labels_do_not_matter(spark, made):
    _, labels, frame, known = made
    swapped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, x) for i, q, t, x in labels], LABELS)
    one, two = ({r.doc_id: r.score for r in toxicity.scored(frame, k).collect()} for k in (known, swapped))
    assert one == two


def test_toxicity_of_edge_rows(spark, made):
    _, _, frame, known = made
    got = toxicity.scored(texts.frame(spark), known).collect()
    assert len(got) == len(texts.rows()) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.scored(texts.frame(spark), spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.scored(texts.frame(spark, []), known).count() == 0


def test_quality_keeps_good_and_rejects_bad(made):
    docs, labels, frame, known = made
    out = quality.judged(frame, known)
    assert out.columns == [*frame.columns, "evidence", "host_posterior", "path_posterior", "quality", "keep"]
    keep = {r.doc_id: r.keep for r in out.collect()}
    assert sum(keep[i] == bool(q) for i, q, *_ in labels) / len(labels) > 0.97


def plain_posteriors(rows):
    """rows (host, path, evidence): mean and, for each row, posteriors of host and path without its own evidence; sums
    and moments in plain Python."""
    total, mean = len(rows), sum(e for *_, e in rows) / len(rows)
    groups = [{}, {}]
    for h, p, e in rows:
        groups[0].setdefault(h, []).append(e)
        groups[1].setdefault((h, p), []).append(e)
    strengths, above, base = [], 1, total * mean**2
    for level in groups:
        within = sum(sum((e - sum(g) / len(g)) ** 2 for e in g) for g in level.values())
        means = sum(len(g) * (sum(g) / len(g)) ** 2 for g in level.values())
        n_groups = len(level) - above + 1
        if n_groups < 2 or total <= n_groups:
            strengths.append(quality.MOST_STRENGTH)
        else:
            spread = (means - base - (n_groups - 1) * within / (total - n_groups)) / (total - sum(len(g) ** 2 for g in level.values()) / total)
            strengths.append(min(quality.MOST_STRENGTH, max(quality.LEAST_STRENGTH, mean * (1 - mean) / spread - 1)) if spread > 0 else quality.MOST_STRENGTH)
        above, base = len(level), means
    out = []
    for h, p, e in rows:
        host = (sum(groups[0][h]) - e + strengths[0] * mean) / (len(groups[0][h]) - 1 + strengths[0])
        out.append((host, (sum(groups[1][h, p]) - e + strengths[1] * host) / (len(groups[1][h, p]) - 1 + strengths[1])))
    return mean, out


def test_quality_equals_plain_python(spark, made):
    pick = random.Random(7)
    docs = [(*d[:2], pick.choice(["en", "de", None]), pick.choice(["a", "a", "a", "b", "c", None]), *d[4:]) for d in made[0]] + [(9000, None, "once", "rare", 0, "x", 1, "y", "z")]
    frame = texts.frame(spark, docs)
    model = quality.fit(frame, made[3])
    evidence = model.evidence([(d[1] or "").encode() for d in docs]).tolist()
    mean, want = plain_posteriors([(d[3], d[2], e) for d, e in zip(docs, evidence, strict=True)])
    logit = lambda x: math.log(x / (1 - x))
    wanted = {d[0]: (e, h, p, 1 / (1 + math.exp(-(logit(e) + logit(p) - logit(mean))))) for d, e, (h, p) in zip(docs, evidence, want, strict=True)}
    got = {r.doc_id: (r.evidence, r.host_posterior, r.path_posterior, r.quality) for r in quality.judged(frame, made[3]).collect()}
    assert got.keys() == wanted.keys()
    assert all(got[i] == pytest.approx(wanted[i], abs=1e-9) for i in got)


def test_many_sites_give_the_same(made, monkeypatch):
    rows = lambda: sorted(tuple(r)[:1] + tuple(round(x, 9) for x in (r.quality, r.path_posterior)) for r in quality.judged(made[2], made[3]).collect())
    want = rows()
    monkeypatch.setattr(quality, "BROADCAST_SITES", 2)
    assert rows() == want


def test_sparse_sites_are_drawn_to_their_prior(spark):
    rows = [("a", "p", 0.9)] * 200 + [("a", "q", 0.1)] * 2 + [("b", "p", 0.2)] * 200 + [("c", "p", 0.9)] * 2 + [("", "", 0.5)] * 3
    scored = spark.createDataFrame(rows, "k0 string, k1 string, e double")
    found, strengths, mean = quality.sites(scored, 2)
    host, path = quality.posteriors(strengths, mean)
    got = {(r.k0, r.k1): (r.h, r.p) for r in scored.join(found, ["k0", "k1"]).select("k0", "k1", host.alias("h"), path.alias("p")).collect()}
    assert set(got) == {("a", "p"), ("a", "q"), ("b", "p"), ("c", "p"), ("", "")}
    assert got["a", "p"][0] > 0.85 and got["b", "p"][0] < 0.25
    assert mean < got["c", "p"][0] < 0.9
    assert 0.1 < got["a", "q"][1] < got["a", "q"][0]


def test_levels_of_urls(spark):
    urls = {"https://Ex.com/a/b?x=/y": ("ex.com", "a", "b"), "http://ex.com": ("ex.com", None, None), "ex.com/a//c#/d": ("ex.com", "a", "c"), None: (None, None, None)}
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: (r.a, r.b, r.c) for r in frame.select("u", *(x.alias(n) for x, n in zip(quality.url_levels(frame.u), "abc", strict=True))).collect()} == urls
    docs = spark.createDataFrame([(i, "some words here", u) for i, u in enumerate(urls)], "doc_id long, text string, url string")
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert quality.judged(docs, labels, quality.url_levels(docs.url)).count() == len(urls)


def test_quality_of_edge_rows(spark, made):
    known = made[3]
    assert quality.judged(texts.frame(spark), known).count() == len(texts.rows())
    assert all(r.evidence == 0.5 for r in quality.judged(texts.frame(spark), spark.createDataFrame([], LABELS)).collect())
    assert quality.judged(texts.frame(spark, []), known).count() == 0


def plain_buckets(text):
    """The buckets of all n-grams of 3 to 5 characters, in integers of any size."""
    codes, out = [ord(c) for c in f" {text.lower()} "], set()
    for n in toxicity.SIZES:
        for i in range(len(codes) - n + 1):
            x = 0
            for c in codes[i : i + n]:
                x = (x * 0x01000193 + c) % 2**32
            x = (x * 0x9E3779B1 + n) % 2**32
            x ^= x >> 15
            out.add((x * 0x9E3779B1) % 2**32 >> (32 - toxicity.BITS))
    return out


def test_toxicity_equals_plain_python(spark, made):
    docs, labels = made[0][:120], [x for x in made[1] if x[0] < 120]
    sets = {d[0]: plain_buckets(d[1]) for d in docs}
    used = [(sets[i], t) for i, _, t, _ in labels if zlib.crc32(str(i).encode()) % 5]
    n = [sum(t == y for _, t in used) for y in (0, 1)]
    ratio, apart = {}, {}
    for b in set().union(*(s for s, _ in used)):
        p, q = ((sum(b in s for s, t in used if t == y) + 1) / (n[y] + 2) for y in (1, 0))
        share = sum(b in s for s, _ in used) / len(used)
        ratio[b], apart[b] = math.log(p / q), (p - q) ** 2 / max(share * (1 - share), 1 / len(used))
    model = toxicity.fit(texts.frame(spark, docs), spark.createDataFrame(labels, LABELS))
    chosen = set(np.flatnonzero(model.feature).tolist())
    edge = min(apart.get(b, 0.0) for b in chosen)
    assert len(chosen) == toxicity.FEATURES and all(b in chosen for b, a in apart.items() if a > edge + 1e-12)
    # The regression, against the same one solved by Newton steps: its steps are bounded, so near the least loss is enough.
    columns, y = sorted(chosen), np.array([t for _, t in used], float)
    scale = np.array([ratio.get(b, 0.0) for b in columns])
    x = np.array([[b in s for b in columns] for s, _ in used]) * scale
    best, c = linear.fit_dense(x, y, toxicity.PENALTY * len(used), rounds=200)
    own = np.divide(model.weight[model.feature[columns]], scale, out=np.zeros(len(scale)), where=scale != 0)
    loss = lambda w, b: np.mean(np.logaddexp(0, x @ w + b) - y * (x @ w + b)) + toxicity.PENALTY / 2 * w @ w
    assert loss(best, c) <= loss(own, model.intercept) + 1e-9 < loss(best, c) + 0.02 < loss(np.zeros(len(scale)), 0.0) / 5
    for i, body, *_ in docs:
        z = sum(model.weight[model.feature[b]] for b in columns if b in sets[i]) + model.intercept
        assert model.score(body.encode()) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_other_labels_bad_bytes_and_repeated_ids(spark, made):
    docs, labels, frame, known = made
    more = spark.createDataFrame([(i, 7, -3, "x") for i in range(400)] + [(None, 1, 1, "x")], LABELS)
    rows = lambda k: sorted((r.doc_id, round(r.score, 9)) for r in toxicity.scored(frame, k).collect())
    assert rows(known.unionByName(more)) == rows(known)
    repeated = frame.unionByName(frame.filter("doc_id = 2").crossJoin(spark.range(30)).drop("id"))
    assert toxicity.fit(repeated, known).intercept == pytest.approx(toxicity.fit(frame, known).intercept)
    bad = frame.selectExpr("doc_id", "cast(X'66ff6f' as string) as text")
    assert toxicity.scored(bad, known).count() == len(docs) and quality.judged(bad.selectExpr("*", "'s' as source", "'l' as lang"), known).count() == len(docs)


def test_quality_leaves_other_columns_alone(made):
    _, _, frame, known = made
    names = ["__host", "__evidence", "__path", "__own", "own", "e", "k0", "n0", "s1", "KEEP"]
    wide = frame.select("doc_id", "text", "source", "lang", *(F.lit(n).alias(n) for n in names))
    out = quality.judged(wide, known)
    assert out.columns == ["doc_id", "text", "source", "lang", *names[:-1], "evidence", "host_posterior", "path_posterior", "quality", "keep"]
    assert all(r[n] == n for r in out.collect() for n in names[:-1])
