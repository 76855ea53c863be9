"""Substring dedup: windows of words that start in an earlier document are removed.

A count-min sketch of all windows, merged from the sketches of the partitions, overestimates how often
each window occurs. A second pass over the texts groups only the windows estimated to be repeated, by a
96-bit fingerprint, so none is lost: an estimate is never below the true count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import sketch
from .common import boxed, covered, hashed, named, rolling_least, text_size, tidy, unboxed, windows
from .repeats import Found, gathered, meeting

#: Bounds of the bits of a sketch row. Beyond the upper one (two rows of 128 MB, whatever the input) more
#: windows pass to the exact pass; the result stays the same.
LEAST_BITS, MOST_BITS, DEPTH = 16, 30, 2

#: Windows meet by the least hash of their runs of so many words.
NEAR = 4


def _row_key(doc_id: str, text: str) -> Column:
    """Tells rows of one id with other texts apart; rows are joined by it and their id."""
    return F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The columns that the passes read: a key of the row's content, the id and the text's bytes."""
    return docs.select(_row_key(doc_id, text).alias("row_key"), F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("binary").alias("body"))


def repeated_windows(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, row_key, late_at: the first words of the windows that also start in a document with a smaller id.

    Null ids and null texts take no part. Rows with the same id do not count against each other."""
    rows = keyed(docs, doc_id, text).filter("doc is not null and body is not null")
    _, size = text_size(rows, "body")
    if window < NEAR:
        raise ValueError(f"a window has {NEAR} words at least")
    bits = sketch.bits_for(size // 2, LEAST_BITS, MOST_BITS)

    def count(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for words in hashed(body.as_py() for body in batch.column("body")):
            lo, hi = windows(*words, window)
            if len(lo):
                yield lo, hi

    shared = docs.sparkSession.sparkContext.broadcast(sketch.merged(rows.select("body"), count, bits, DEPTH))

    def find(batch: pa.RecordBatch) -> Iterator[Found]:
        estimate = shared.value
        for key, doc, words in zip(batch.column("row_key"), batch.column("doc"), hashed(b.as_py() for b in batch.column("body")), strict=True):
            lo, hi = windows(*words, window)
            at = np.flatnonzero(estimate.repeated(lo, hi))
            if len(at):
                near = rolling_least(windows(*words, NEAR)[0], window - NEAR + 1)
                yield key.as_py(), doc.as_py(), lo[at], hi[at], at.astype("<u4"), near[at]

    return gathered(meeting(rows, find, size))


def with_removals(docs: DataFrame, late: DataFrame, window: int, doc_id: str, text: str, added: str, finish: Callable[[bytes | None, list[bytes], np.ndarray], tuple], replaced: str | None = None) -> DataFrame:
    """Join the windows to their texts and call finish(body, words, removed mask) -> values of the added columns.

    The added columns come after those of docs, in place of any of their names; with `replaced` the one column added
    takes the place and name of that one instead."""
    names, kinds = zip(*(x.split() for x in added.split(", ")), strict=True)
    kept = docs.columns if replaced else named(docs.columns, names)
    own = docs.select(boxed(docs, kept).alias("own"), F.col(f"`{doc_id}`").cast("long").alias("doc"), _row_key(doc_id, text).alias("row_key"), *([] if text in kept else [F.col(f"`{text}`").alias("body")]))
    both = own.join(late.hint("shuffle_hash"), ["doc", "row_key"], "left").drop("doc", "row_key")
    place = kept.index(text) if text in kept else None  # the text travels once, within `own`
    types = [{"long": pa.int64(), "string": pa.string()}[k] for k in kinds]
    added_as = [f"new_{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            bodies = (batch.column("body") if place is None else batch.column("own").field(place)).cast(pa.binary())
            for body, late_at in zip(bodies, batch.column("late_at"), strict=True):
                words = (body.as_py() or b"").split()
                starts = np.frombuffer(b"".join(late_at.as_py() or ()), "<u4").astype(np.int64)
                rows.append(finish(body.as_py(), words, covered(starts, window, len(words))))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("own"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["own", *added_as])

    form = StructType([own.schema["own"], *(StructField(n, {"long": LongType(), "string": StringType()}[k]) for n, k in zip(added_as, kinds, strict=True))])
    out = both.mapInArrow(tidy(run), form)
    if replaced:
        return out.select(*(F.col("new_0").alias(c) if c == replaced else was for c, was in zip(kept, unboxed(kept), strict=True)))
    return out.select(*unboxed(kept), *(F.col(n).alias(name) for n, name in zip(added_as, names, strict=True)))


def digests(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs with n_words, n_removed and kept_sha256 of what is left, joined by one space.

    Words are runs of bytes other than ASCII white space. A null or empty text has no words; a text of fewer
    words than a window, or a null id, loses none. Repeated rows are judged alike. Columns of docs named as one of the three,
    in any case, are replaced. Empty input: no rows."""

    def finish(body: bytes | None, words: list[bytes], gone: np.ndarray) -> tuple:
        left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        return len(words), int(gone.sum()), hashlib.sha256(b" ".join(left)).hexdigest()

    late = repeated_windows(docs, window, doc_id, text)
    return with_removals(docs, late, window, doc_id, text, "n_words long, n_removed long, kept_sha256 string", finish)
