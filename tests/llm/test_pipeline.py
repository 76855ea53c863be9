import hashlib
import itertools
import json
import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from ledgerframe.llm import quality, queries
from ledgerframe.llm.common import table
from tests.llm import test_bpe, test_classifiers, test_decontam, test_jaccard, test_repeats


def test_names():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    top, docs, out = tmp_path_factory.mktemp("pipeline"), table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        out.append((name, before, docs))
    return out


def test_each_stage_takes_effect(stages):
    names = [n for n, *_ in stages]
    assert len(names) == 5
    for name, before, after in stages[:4]:
        assert after.columns == list(corpus_pipeline.COLUMNS), name
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    first, second = stages[0], stages[1]
    assert first[2].count() < first[1].count() and second[2].count() < second[1].count()
    assert all(r.n_chars == len(r.text) for r in stages[2][2].collect())
    last = stages[4][2]
    assert last.filter("decoded_sha256 <> sha2(cast(text as binary), 256)").count() == 0


def test_run_gives_the_rows_of_the_stages(spark, sf_dir, stages):
    rows = lambda df: sorted(json.dumps(r.asDict(), default=str) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(stages[-1][2])


def leaks(text, item):
    """Whether a text covers half of an item by greedy tiles of four words and more; a shorter item must be there whole."""
    p, t = (re.sub(r"[!-/:-@\[-`{-~]", " ", x or "").lower().split() for x in (item, text))
    if len(p) < 4:
        return bool(p) and any(t[j : j + len(p)] == p for j in range(len(t)))
    return sum(n for *_, n in test_decontam.brute_tiles(p, t, 4)) >= 0.5 * len(p)


def cut(text, gone):
    """The text without the words that are gone; what a cut separates is joined by one space."""
    if not any(gone):
        return text
    body, n = text.encode(), len(gone)
    places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", body)]
    runs = [list(g) for is_gone, g in itertools.groupby(range(n), gone.__getitem__) if not is_gone]
    return b" ".join(body[(places[r[0]][0] if r[0] else 0) : (places[r[-1]][1] if r[-1] < n - 1 else len(body))] for r in runs).decode()


def small_corpus(n=260):
    pick = random.Random(5)
    prose = ["the", "of", "and", "house", "river", "was", "a", "small", "old", "in", "it", "went", "there", "people", "said", "light", "never", "again", "over", "water"]
    made = lambda k: [pick.choice(prose) + pick.choice(["", "", "s", "ed"]) for _ in range(k)]
    passage, items = made(60), [made(12), made(25), made(30), ["one", "two"], []]
    docs = []
    for i in range(n):
        kind = i % 10
        if kind in (0, 1) and docs:  # a near copy
            words = pick.choice(docs)[1].split()
            words = words[: len(words) - pick.randrange(1, 3)] if len(words) > 30 else words
            text = " ".join(words)
        elif kind == 2:
            text = " ".join(made(pick.randrange(40)) + passage[: pick.randrange(50, 61)] + made(pick.randrange(40)))
        elif kind == 3:
            own = pick.choice(items)
            text = ", ".join(made(10) + own[len(own) // 2 :] + made(5) + own[: len(own) // 2] + made(9)).upper()
        elif kind == 4:
            text = " ".join(pick.choice(["$$$", "click", "!!!!", "4711", "xXx", "BUY"]) for _ in range(pick.randrange(1, 60)))
        else:
            text = pick.choice([" ", "\n", "\t "]).join(made(pick.randrange(0, 90))) + pick.choice(["", ".", "\n"])
        docs.append((i, text, pick.choice(["en", "de"]), pick.choice(["a", "a", "b", None]), len(text)))
    labels = [(i, 0 if i % 10 == 4 else 1, 0) for i in range(0, n, 2)]
    return docs, labels, [(k, " ".join(x)) for k, x in enumerate(items)]


def test_pipeline_by_force(spark, tmp_path):
    """All stages by their definitions: posteriors in plain Python, all pairs of documents, all windows of 50 words, all
    items of the benchmark, the library of ranks."""
    docs, labels, items = small_corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    evidence = quality.fit(frame, marks).evidence([d[1].encode() for d in docs]).tolist()
    mean, sites = test_classifiers.plain_posteriors([(d[3], d[2], e) for d, e in zip(docs, evidence, strict=True)])
    logit = lambda x: math.log(x / (1 - x))
    good = [(d[0], d[1]) for d, e, (_, path) in zip(docs, evidence, sites, strict=True) if 1 / (1 + math.exp(-(logit(e) + logit(path) - logit(mean)))) >= quality.REJECT_BELOW]
    one = [d for d, (i, _, root) in zip(good, test_jaccard.brute(good, 5, 80), strict=True) if root == i]
    short = [(i, cut(t, gone)) for (i, t), (_, _, gone) in zip(one, test_repeats.brute(one, 50), strict=True)]
    free = {i: t for i, t in short if not any(leaks(t, x) for _, x in items)}
    assert len(docs) > len(good) > len(one) > len(free) > 60 and short != one  # every stage takes effect
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r.text for i, r in got.items()} == free
    library = test_bpe.reference()
    for i, r in got.items():
        ids = np.array(library.encode_ordinary(r.text), "<u4").tobytes()
        assert (bytes(r.bpe_ids), r.n_tokens, r.ids_sha256) == (ids, len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.n_chars == len(r.text) and r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
