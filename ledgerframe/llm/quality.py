"""Quality classifier with hierarchical empirical Bayes over sites.

A document classifier on measures of the text gives its evidence. Evidence is then summed by host and by
path prefixes within the host; a site's posterior mean is drawn towards its prior, hosts towards the global mean
and paths towards the level above, the more the fewer documents they have. The strength of each prior is estimated
from how much the means of sites differ beyond chance. A document's quality joins its own evidence with what the
other documents of its site tell: its own is left out of the sums it is judged by.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import boxed, checkpointed, labelled, named, tidy, unboxed
from .linear import fit_dense, sigmoid

#: Labelled rows that the document classifier uses at most: those of least hash of their ids.
FIT_ROWS = 20_000
PENALTY, REJECT_BELOW = 1.0, 0.5
#: Sites up to this number are broadcast (some tens of MB); more are joined by their keys.
BROADCAST_SITES = 200_000
#: Bounds of a prior's strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e4
#: Evidence is kept this far from 0 and 1.
EDGE = 1e-4
_SYMBOLS = np.frombuffer(b"%$#*&|~^=<>_@{}[]\\", np.uint8)


def measures(body: bytes) -> np.ndarray:
    """Shares and means that describe a text as a whole."""
    n = max(1, len(body))
    count = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    words = body.split()
    lines = body.splitlines()
    upper, lower = count[65:91].sum(), count[97:123].sum()
    w = max(1, len(words))
    return np.array([
        np.log1p(len(words)),
        upper / max(1, upper + lower),
        count[48:58].sum() / n,
        count[33] / w,
        count[_SYMBOLS].sum() / w,
        count[124] / w,
        (count[44] + count[46]) / w,
        count[128:].sum() / n,
        min(40.0, n / w),
        len(set(words)) / w,
        len(set(lines)) / max(1, len(lines)),
        min(5.0, np.log1p(w / max(1, len(lines)))),
    ])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    intercept: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.c_[z, z**2]

    def evidence(self, bodies: list[bytes]) -> np.ndarray:
        if not bodies:
            return np.empty(0)
        x = self.inputs(np.array([measures(b) for b in bodies]))
        return np.clip(sigmoid(x @ self.weight + self.intercept), EDGE, 1 - EDGE)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Of a document labelled twice the smaller label counts, and labels other than 0 and 1 do not; of rows with one
    id the text of least hash. Without labels of both classes the evidence is their smoothed share."""
    taken = []
    for r in labelled(docs, labels, doc_id, text, label, F.min, FIT_ROWS).mapInArrow(tidy(_measured), "id long, y int, x array<double>").toLocalIterator():  # FIT_ROWS short rows
        taken.append((r.id, r.y, tuple(r.x)))
    taken.sort()
    width = len(measures(b""))
    x, y = np.array([r[2] for r in taken]).reshape(-1, width), np.array([r[1] for r in taken], float)
    share = (y.sum() + 1) / (len(y) + 2)
    base = Model(x.mean(axis=0) if len(x) else np.zeros(width), np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(width), np.zeros(2 * width), float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return base
    weight, intercept = fit_dense(base.inputs(x), y, PENALTY)
    return Model(base.mean, base.spread, weight, intercept)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [measures(b.as_py()).tolist() for b in batch.column("body")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "x"])


def _with_evidence(rows: DataFrame, model: Model) -> DataFrame:
    """rows (own, keys, body) with the column e in place of body."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in rows.schema if f.name != "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.evidence([b.as_py() or b"" for b in batch.column("body")])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(got, pa.float64())], names=[*(f.name for f in kept), "e"])

    return rows.mapInArrow(tidy(run), StructType([*kept, StructField("e", DoubleType())]))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(n: float, groups: float, squares: float, within: float, between: float, mean: float) -> float:
    """Documents that a prior weighs, by moments: n documents in groups with sum of squared sizes `squares`, sums of
    squares within and between groups, about the overall mean."""
    if groups < 2 or n <= groups:
        return MOST_STRENGTH
    noise = within / (n - groups)
    spread = (between - (groups - 1) * noise) / max(1e-9, n - squares / n)
    return float(np.clip(mean * (1 - mean) / spread - 1, LEAST_STRENGTH, MOST_STRENGTH)) if spread > 0 else MOST_STRENGTH


def url_levels(url: Column, depth: int = 3) -> list[Column]:
    """Host and the first path segments of a URL, as levels for judged(): null where a URL has fewer."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"(?s)^[a-z][a-z0-9+.-]*://|[?#].*$", "")
    parts = F.filter(F.split(bare, "/"), lambda p: p != "")
    return [F.get(parts, F.lit(i)) for i in range(depth)]


def sites(scored: DataFrame, levels: int) -> tuple[DataFrame, list[float], float]:
    """From columns k0, k1, ... and the evidence e: a row for each finest site with documents and sums of evidence at
    every level (n0, s0, n1, s1, ...); the strength of the prior at every level; and the global mean."""
    keys, e = [f"k{j}" for j in range(levels)], F.col("e")
    finest = checkpointed(scored.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("ss")))  # a row a site
    out = finest.select(*keys, F.col("n").alias(f"n{levels - 1}"), F.col("s").alias(f"s{levels - 1}"))
    sums = []
    for j in range(levels):
        at = finest.groupBy(*keys[: j + 1]).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
        if j < levels - 1:
            out = out.join(at.select(*keys[: j + 1], F.col("n").alias(f"n{j}"), F.col("s").alias(f"s{j}")), keys[: j + 1])
        sums.append(at.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n").cast("double") ** 2).alias("sq"), F.sum(F.col("ss") - F.col("s") ** 2 / F.col("n")).alias("within"), F.sum(F.col("s") ** 2 / F.col("n")).alias("means")).first())
    total = float(sums[0]["n"] or 0)
    mean = min(1 - EDGE, max(EDGE, float(sums[0]["s"]) / total)) if total else 0.5
    strengths, groups, means = [], 1, total * mean**2
    for x in sums:
        strengths.append(_strength(total, x["g"] - groups + 1, float(x["sq"] or 0), float(x["within"] or 0), float(x["means"] or 0) - means, mean))
        groups, means = x["g"], float(x["means"] or 0)
    return out, strengths, mean


def posteriors(strengths: list[float], mean: float) -> list[Column]:
    """Posterior mean at every level from the columns of sites() and e, the row's own evidence, which is left out."""
    out, prior = [], F.lit(mean)
    for j, strength in enumerate(strengths):
        prior = (F.col(f"s{j}") - F.col("e") + strength * prior) / (F.col(f"n{j}") - 1 + strength)
        out.append(prior)
    return out


def judged(docs: DataFrame, labels: DataFrame, levels: Sequence[Column | str] = ("source", "lang"), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs with evidence, host_posterior, path_posterior (of the finest level), quality and keep
    (quality of REJECT_BELOW or more).

    levels: columns from host to finest path prefix; url_levels() makes them from a URL. The default stands in for a
    table without URLs. A null text is judged as an empty one, bytes are taken as they are; nulls in levels are sites
    of their own; repeated rows are judged alike and each counts. Columns of docs named as one of the five, in any
    case, are replaced; all others stay, whatever their names. Empty input: no rows."""
    added = ["evidence", "host_posterior", "path_posterior", "quality", "keep"]
    kept, count = named(docs.columns, added), len(levels)
    model = fit(docs, labels, doc_id, text)
    # No key is null: joins by equality then find sites of nulls too.
    keys = [F.coalesce(F.concat(F.lit("="), (F.col(f"`{x}`") if isinstance(x, str) else x).cast("string")), F.lit("")).alias(f"k{j}") for j, x in enumerate(levels)]
    body = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("body")
    found, strengths, mean = sites(_with_evidence(docs.select(*keys, body), model), count)
    rows = _with_evidence(docs.select(boxed(docs, kept).alias("own"), *keys, body), model)
    names, finest = [f"k{j}" for j in range(count)], f"n{count - 1}"
    n_sites = found.count()
    if n_sites <= BROADCAST_SITES:
        joined = rows.join(F.broadcast(found), names)
    else:  # sites with many documents are few and broadcast; of the others none is large enough to fill a task
        edge = (found.agg(F.sum(finest)).first()[0] or 0) // BROADCAST_SITES
        large = F.broadcast(found.filter(F.col(finest) > edge))
        joined = rows.join(large, names).unionByName(rows.join(large, names, "left_anti").join(found.filter(F.col(finest) <= edge), names))
    base, after = float(np.log(mean / (1 - mean))), posteriors(strengths, mean)
    out = joined.select("own", "e", after[0].alias("host"), after[-1].alias("path"))
    quality = 1 / (1 + F.exp(-(_logit(F.col("e")) + _logit(F.col("path")) - base)))
    return out.withColumn("q", quality).select(*unboxed(kept), F.col("e").alias("evidence"), F.col("host").alias("host_posterior"), F.col("path").alias("path_posterior"), F.col("q").alias("quality"), (F.col("q") >= REJECT_BELOW).alias("keep"))
