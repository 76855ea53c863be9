"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts become sets of hashed character n-grams. Over the labelled rows used for fitting, each n-gram's
log-count ratio between toxic and other texts is summed up in the cluster; the n-grams that tell the classes
apart best are kept, scaled by their ratios, and weighted by logistic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled, tidy
from .linear import fit_sparse, sigmoid

#: Labelled rows that the fit uses at most: those of least hash of their ids.
FIT_ROWS = 20_000
#: Documents that are held out: SQL on the column `id`, the id as a number.
HELD_OUT = "crc32(cast(id as string)) % 5 = 0"
BITS, SIZES, FEATURES, SMOOTHING, PENALTY = 20, (3, 4, 5), 1_024, 1.0, 1e-4
_SLICES = 64
_BASE, _ODD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def buckets(body: bytes) -> np.ndarray:
    """Buckets of all character n-grams of the lower-cased text, with repeats. Bytes that are no UTF-8 count as U+FFFD."""
    codes = np.frombuffer(f" {body.decode('utf-8', 'replace').lower()} ".encode("utf-32-le", "replace"), np.uint32)
    out, rolled = [], codes
    for n in range(2, SIZES[-1] + 1):
        rolled = rolled[:-1] * _BASE + codes[n - 1 :] if len(rolled) else rolled
        if n in SIZES:
            x = rolled * _ODD + np.uint32(n)
            x ^= x >> np.uint32(15)
            out.append((x * _ODD) >> np.uint32(32 - BITS))
    return np.concatenate(out)


@dataclass(frozen=True)
class Model:
    """Bounded by the parameters: a feature number for each bucket (0: none), and their weights."""

    feature: np.ndarray
    weight: np.ndarray
    intercept: float

    def present(self, body: bytes) -> np.ndarray:
        found = self.feature[buckets(body)]
        return np.unique(found[found > 0])

    def score(self, body: bytes | None) -> float:
        return float(sigmoid(self.weight[self.present(body or b"")].sum() + self.intercept))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fitted on labelled rows whose crc32(doc_id as text) mod 5 is not 0. Of a document labelled twice the larger
    label counts, and labels other than 0 and 1 do not; of rows with one id the text of least hash. Without labels of
    both classes every score is the smoothed share of toxic rows."""
    size = 1 << BITS
    rows = labelled(docs, labels, doc_id, text, label, F.max, FIT_ROWS, f"not ({HELD_OUT})").select("body", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, size), "<u4"), [0, 0]
        for batch in batches:
            for body, y in zip(*batch.columns, strict=True):
                total[y.as_py(), np.unique(buckets(body.as_py()))] += 1
                n[y.as_py()] += 1
        if any(n):
            parts = total.reshape(2, _SLICES, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(_SLICES), pa.int32()), *(pa.array([parts[y, k].tobytes() for k in range(_SLICES)], pa.binary()) for y in (0, 1)), *(pa.array([n[y]] * _SLICES, pa.int64()) for y in (0, 1))],
                names=["slice", "none", "toxic", "n0", "n1"],
            )

    def add(table: pa.Table) -> pa.Table:
        sums = [np.sum([np.frombuffer(x, "<u4") for x in table[c].to_pylist()], axis=0).astype("<u4").tobytes() for c in ("none", "toxic")]
        return pa.table({"slice": table["slice"][:1], "none": [sums[0]], "toxic": [sums[1]], "n0": [sum(table["n0"].to_pylist())], "n1": [sum(table["n1"].to_pylist())]})

    form = "slice int, none binary, toxic binary, n0 long, n1 long"
    counts, n = np.zeros((2, size)), (0, 0)
    for one in rows.mapInArrow(tidy(count), form).groupBy("slice").applyInArrow(add, form).toLocalIterator():  # 8 MB in all
        at = slice(one["slice"] * size // _SLICES, (one["slice"] + 1) * size // _SLICES)
        counts[0, at], counts[1, at], n = np.frombuffer(one["none"], "<u4"), np.frombuffer(one["toxic"], "<u4"), (one["n0"], one["n1"])
    share = (n[1] + SMOOTHING) / (sum(n) + 2 * SMOOTHING)
    if not n[0] or not n[1]:
        return Model(np.zeros(size, np.uint16), np.zeros(1), float(np.log(share / (1 - share))))
    p, q = ((counts[y] + SMOOTHING) / (n[y] + 2 * SMOOTHING) for y in (1, 0))
    ratio = np.log(p / q)
    mean = counts.sum(axis=0) / sum(n)
    apart = (p - q) ** 2 / np.maximum(mean * (1 - mean), 1 / sum(n))
    best = np.argsort(-apart, kind="stable")[:FEATURES]
    feature = np.zeros(size, np.uint16)
    feature[best] = np.arange(1, len(best) + 1)
    scale = np.r_[0.0, ratio[best]]
    chosen = docs.sparkSession.sparkContext.broadcast(Model(feature, scale, 0.0))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([chosen.value.present(x.as_py()).astype("<u2").tobytes() for x in batch.column(0)], pa.binary()), batch.column(1)], names=["found", "y"])

    found = sorted((x.y, bytes(x.found)) for x in rows.mapInArrow(tidy(pick), "found binary, y int").toLocalIterator())  # FIT_ROWS rows of FEATURES numbers at most
    taken = [(np.frombuffer(x, "<u2").astype(np.int64), y) for y, x in found]
    places = np.repeat(np.arange(len(taken)), [len(x) for x, _ in taken])
    w, b = fit_sparse(places, np.concatenate([x for x, _ in taken]), scale, np.array([y for _, y in taken], float), PENALTY)
    return Model(feature, w * scale, b)


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its whole text alone.

    A null text scores as an empty one; a null doc_id is not held out. Repeated rows score alike. Bytes that are no
    UTF-8 count as U+FFFD. Other columns are ignored, whatever their names. Empty input: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([shared.value.score(x.as_py()) for x in batch.column("body")], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("body")).select(F.col("id").alias("doc_id"), F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "body")
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")
