"""Which windows of words also start in a document with a smaller id: the exact pass.

Each task first settles what it can by itself: of the windows it holds with one fingerprint, only those of
its smallest document can still be first overall. So one record for each task and distinct window is
shuffled, however often a passage occurs, and a task of the shuffle gets at most one record of a passage
from each task before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, release, tidy

#: Windows that a task gathers before it settles and sends them.
FLUSH_WINDOWS = 1_000_000
#: Bytes of text for which there is one bucket of the exact pass.
BUCKET_TEXT = 12_000_000
#: Windows that one hash of their surroundings deals together are spread over one in so many of all buckets, so that
#: a phrase that very many texts share, in ever other surroundings, does not fill one bucket.
SPREAD = 64
#: Groups at least in which settled rows pass.
LEAST_GROUPS = 256
_ZSTD = zstandard.ZstdCompressor(level=1)
_SENT = "bucket int, lo binary, hi binary, doc binary, row binary, at binary, weight binary, done_doc long, done_row long"
#: What a bucket found, packed by parts of the documents: a record for each part, not for each document.
PACKED = "part int, doc binary, row_key binary, at binary"

#: What a finder yields for a document: row key, document id, fingerprints (128 bits, of which 96 are compared),
#: their first words, and a hash that is the same for equal windows and mostly for neighbouring ones: windows of
#: one hash meet in one place, so what goes back to a document are few rows.
Found = tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def starts_of(*sorted_columns: np.ndarray) -> np.ndarray:
    """True where a run of equal values begins."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def later(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where a smaller document has the same fingerprint."""
    order = np.lexsort((doc, hi, lo))
    new = starts_of(lo[order], hi[order])
    first = doc[order][new][np.cumsum(new) - 1]
    out = np.empty(len(lo), bool)
    out[order] = doc[order] > first
    return out


def pack(values: np.ndarray) -> bytes:
    """Integers in runs, as compressed steps."""
    return _ZSTD.compress(np.diff(values, prepend=values.dtype.type(0)).tobytes())


def unpack(packed: bytes, kind: str) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(packed), kind), dtype=kind)


def by_row(doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Places gathered by document and row key: doc, row_key, at."""
    order = np.lexsort((at, row, doc))
    doc, row, at = doc[order], row[order], at[order].astype("<u4")
    starts = np.flatnonzero(starts_of(doc, row))
    ends = np.append(starts, len(row))[1:]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[starts], pa.int64()), pa.array(row[starts], pa.int64()), pa.array([at[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())],
        names=["doc", "row_key", "at"],
    )


def buckets_for(text_bytes: int) -> int:
    return max(1, -(-text_bytes // BUCKET_TEXT))


class Runs:
    """Equal fingerprints of a set of windows: which are found, which are sent on, and what a record stands for."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, weight: np.ndarray | None = None) -> None:
        self.order = np.lexsort((doc, hi, lo))
        new = starts_of(lo[self.order], hi[self.order])
        self.run, self.begin = np.cumsum(new) - 1, np.flatnonzero(new)
        self.end = np.append(self.begin, len(lo))[1:] - 1
        ordered = doc[self.order]
        self.several = ordered[self.begin] != ordered[self.end]
        self.total = np.add.reduceat((np.ones(len(lo), np.int64) if weight is None else weight)[self.order], self.begin) if len(lo) else np.empty(0, np.int64)

    def found(self) -> np.ndarray:
        """True where another document has the same fingerprint: sorted, an end of its run is of another document."""
        out = np.empty(len(self.order), bool)
        out[self.order] = self.several[self.run]
        return out

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The records of each run's first and last document, and how many windows each of all records stands for."""
        out, weight = np.zeros(len(self.order), bool), np.zeros(len(self.order), np.int64)
        out[self.order[self.begin]] = out[self.order[self.end]] = True
        weight[self.order[self.begin]] = self.total
        return out, weight


def meeting(source: DataFrame, find: Callable[[pa.RecordBatch], Iterator[Found]], text_bytes: int, hot: int = 0) -> DataFrame:
    """For each document and row key the first words (binary of unsigned 32-bit integers, one or more rows a key,
    perhaps with repeats) of its windows that also start in a document with a smaller id.

    With hot, of those that start in another document, whichever has the smaller id; and a row without a key that
    holds fingerprints (64 bits) that occur `hot` times or more, if there are any."""
    buckets = buckets_for(text_bytes)
    spread = -(-buckets // SPREAD)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Found] = []
        size = 0

        def send_on() -> Iterator[pa.RecordBatch]:
            n = [len(x[2]) for x in held]
            row, doc = np.repeat(np.array([x[0] for x in held], np.int64), n), np.repeat(np.array([x[1] for x in held], np.int64), n)
            lo, hi, at, near = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4, 5))
            held.clear()
            hi = (hi >> np.uint64(32)).astype("<u4")
            if hot:
                runs = Runs(lo, hi, doc)
                settled = runs.found()
                ends, weight = runs.ends()
                on = ~settled | ends
            else:
                settled = later(lo, hi, doc)
                on, weight = ~settled, None
            if settled.any():
                done = by_row(doc[settled], row[settled], at[settled])
                k = done.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, -1, np.int32)), *([pa.nulls(k, pa.binary())] * 4), done["at"], pa.nulls(k, pa.binary()), done["doc"], done["row_key"]], names=["bucket", "lo", "hi", "doc", "row", "at", "weight", "done_doc", "done_row"])
            row, doc, lo, hi, at, near = (x[on] for x in (row, doc, lo, hi, at, near))
            weight = weight[on] if hot else None
            bucket = ((mixed(near) + mixed(lo) % np.uint64(spread)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(starts_of(bucket[order]))
            parts = [order[s:e] for s, e in zip(starts, np.append(starts, len(order))[1:], strict=True)]
            if parts:
                k = len(parts)
                packed = [pa.array([write(x[p]) for p in parts], pa.binary()) for x, write in ((lo, np.ndarray.tobytes), (hi, np.ndarray.tobytes), (doc, pack), (row, pack), (at, pack))]
                weights = pa.array([pack(weight[p]) for p in parts], pa.binary()) if hot else pa.nulls(k, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), *packed, weights, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=["bucket", "lo", "hi", "doc", "row", "at", "weight", "done_doc", "done_row"])

        for batch in batches:
            for found in find(batch):
                if len(found[2]):
                    held.append(found)
                    size += len(found[2])
                    if size >= FLUSH_WINDOWS:
                        yield from send_on()
                        size = 0
        if held:
            yield from send_on()

    def meet(table: pa.Table) -> pa.Table:
        lo, hi = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("lo", "<u8"), ("hi", "<u4")))
        doc, row, at = (np.concatenate([unpack(x, kind) for x in table[c].to_pylist()]) for c, kind in (("doc", "<i8"), ("row", "<i8"), ("at", "<u4")))
        if not hot:
            late = later(lo, hi, doc)
            return pa.Table.from_batches([by_row(doc[late], row[late], at[late])])
        runs = Runs(lo, hi, doc, np.concatenate([unpack(x, "<i8") for x in table["weight"].to_pylist()]))
        found = runs.found()
        out = pa.Table.from_batches([by_row(doc[found], row[found], at[found])])
        common = lo[runs.order[runs.begin[runs.total >= hot]]]
        return pa.concat_tables([out, pa.table({"doc": pa.nulls(1, pa.int64()), "row_key": pa.nulls(1, pa.int64()), "at": pa.array([common.tobytes()], pa.binary())})]) if len(common) else out

    return exchanged(source.mapInArrow(tidy(send), _SENT), buckets, meet)


def exchanged(sent: DataFrame, buckets: int, meet: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """meet of each bucket, PACKED. Rows of bucket -1 are settled: spread by document and row, they pass as they are. A row
    without a key goes to part -1.

    The windows that a document shares are spread over ever more buckets as these become more. Packed by parts, that makes
    longer records rather than more rows."""
    parts = max(buckets, LEAST_GROUPS)
    dealt = sent.withColumn("spread", F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("done_doc", "done_row"), F.lit(parts))).otherwise(F.col("bucket")))

    def either(table: pa.Table) -> pa.Table:
        if table["spread"][0].as_py() < 0:
            return packed(table["done_doc"], table["done_row"], table["at"], parts)
        try:
            found = meet(table)
            return packed(found["doc"], found["row_key"], found["at"], parts)
        finally:
            release()

    return dealt.groupBy("spread").applyInArrow(either, PACKED)


def packed(docs: pa.ChunkedArray, rows: pa.ChunkedArray, places: pa.ChunkedArray, parts: int) -> pa.Table:
    """Rows of document, row key and places (unsigned 32-bit) as PACKED: the places of a part one after another, each with
    its document and row key."""
    hot = [x.as_py() for x, d in zip(places, docs, strict=True) if not d.is_valid]
    at = [x.as_py() for x, d in zip(places, docs, strict=True) if d.is_valid]
    doc, row = (np.array([x for x in c.to_pylist() if x is not None], np.int64) for c in (docs.filter(docs.is_valid()), rows.filter(docs.is_valid())))
    part = (mixed(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((row, doc, part))
    cuts = np.flatnonzero(starts_of(part[order]))
    out: dict[str, list] = {"part": [-1] * len(hot), "doc": [b""] * len(hot), "row_key": [b""] * len(hot), "at": hot}
    for s, e in zip(cuts, np.append(cuts, len(order))[1:], strict=True):
        own = order[s:e]
        size = np.array([len(at[i]) // 4 for i in own], np.int64)
        out["part"].append(int(part[own[0]]))
        out["doc"].append(pack(np.repeat(doc[own], size)))
        out["row_key"].append(pack(np.repeat(row[own], size)))
        out["at"].append(pack(np.frombuffer(b"".join(at[i] for i in own), "<u4")))
    return pa.table({"part": pa.array(out["part"], pa.int32()), **{c: pa.array(out[c], pa.binary()) for c in ("doc", "row_key", "at")}})


def gathered(found: DataFrame) -> DataFrame:
    """doc, row_key and late_at of PACKED rows, one row a key; what is gathered is bounded by the words of one text."""

    def unpacked(table: pa.Table) -> pa.Table:
        try:
            doc, row, at = (np.concatenate([unpack(x, kind) for x in table[c].to_pylist()]) for c, kind in (("doc", "<i8"), ("row_key", "<i8"), ("at", "<u4")))
            return pa.Table.from_batches([by_row(doc, row, at)])
        finally:
            release()

    kept = found.filter("part >= 0").groupBy("part").applyInArrow(unpacked, "doc long, row_key long, at binary")
    return kept.select("doc", "row_key", F.array("at").alias("late_at"))


def hot_places(found: DataFrame) -> DataFrame:
    """`at` of the rows without a key."""
    return found.filter("part < 0").select("at")
