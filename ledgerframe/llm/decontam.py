"""Benchmark decontamination by greedy string tiling.

Seeds are runs of `least` words that a text shares with a benchmark item. Items whose seeds could cover enough of
them are tiled: running Karp-Rabin finds the longest common runs of unmarked words, marks them in both texts
without overlap and goes on with shorter ones, down to `least` words. Coverage of the item by its tiles
decides, so passages in another order are found too.
"""

from __future__ import annotations

import heapq
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_LO, hashed, mixed, tidy

#: Bytes of benchmark text that are broadcast at once (as arrays of about five times that). A larger benchmark is
#: taken in shards, each with a pass over the documents.
SHARD_BYTES = 8_000_000
LEAST, COVERAGE = 4, 0.5
#: Common runs that are queued at once, where a finer step of the length can help it.
MOST_RUNS = 2_000_000
_SPACED = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_PATTERN_EDGE, _TEXT_EDGE = np.uint64(0), np.uint64(1)


def spaced(body: bytes | None) -> bytes:
    """Lower-cased, ASCII punctuation as white space. Bytes that are no UTF-8 count as U+FFFD."""
    return (body or b"").decode("utf-8", "replace").lower().encode("utf-8").translate(_SPACED)


def rolled(words: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of every run of `length` words: of halves, H(i, 2n) = H(i, n) * BASE^n + H(i + n, n)."""
    if len(words) < length:
        return np.empty(0, np.uint64)
    whole, out, done = mixed(words), None, 0
    n = 1  # runs of powers of two make up any length
    while n <= length:
        power = np.uint64(pow(int(BASE_LO), n, 1 << 64))
        if length & n:
            out = whole[: len(words) - length + 1] if out is None else out * power + whole[done : done + len(words) - length + 1]
            done += n
        whole = whole[:-n] * power + whole[n:] if 2 * n <= length else whole
        n *= 2
    return mixed(out)


def _free(used: np.ndarray, length: int) -> np.ndarray:
    """Starts of the runs of `length` unmarked words."""
    marked = np.cumsum(np.r_[0, used])
    return np.flatnonzero(marked[length:] == marked[:-length]) if len(used) >= length else np.empty(0, np.int64)


def _runs(pattern: np.ndarray, text: np.ndarray, used_p: np.ndarray, used_t: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each unmarked run of the pattern, the ranges of text runs (in an order of their own) with which a common
    run of `length` words or more begins: those of its hash, but for the ones after the same unmarked word, which
    continue a run that began before."""
    p, t = _free(used_p, length), _free(used_t, length)
    hash_p, hash_t = rolled(pattern, length)[p], rolled(text, length)[t]
    before = lambda words, used, at, edge: np.where((at == 0) | used[at - 1], edge, words[at - 1])
    pred_p, pred_t = before(pattern, used_p, p, _PATTERN_EDGE), before(text, used_t, t, _TEXT_EDGE)
    order = np.lexsort((pred_t, hash_t))
    t, hash_t, pred_t = t[order], hash_t[order], pred_t[order]
    begin, end = np.searchsorted(hash_t, hash_p), np.searchsorted(hash_t, hash_p, "right")
    some = begin < end
    p, pred_p, begin, end = p[some], pred_p[some], begin[some], end[some]
    pair = np.empty(len(t), [("h", np.uint64), ("w", np.uint64)])
    pair["h"], pair["w"] = hash_t, pred_t
    want = np.empty(len(p), pair.dtype)
    want["h"], want["w"] = hash_t[begin], pred_p
    same, over = np.searchsorted(pair, want), np.searchsorted(pair, want, "right")
    return t, np.r_[p, p], np.r_[begin, over], np.r_[same - begin, end - over]


def _extended(pattern: np.ndarray, text: np.ndarray, used_p: np.ndarray, used_t: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """How long the common runs of unmarked words are that begin at left and right with `length` equal words: steps of
    halving lengths, each taken where the hashes of what it adds agree."""
    n, step = np.full(len(left), length), 1
    room = np.minimum(len(pattern) - left, len(text) - right)
    marked_p, marked_t = np.cumsum(np.r_[0, used_p]), np.cumsum(np.r_[0, used_t])
    while 2 * step <= room.max(initial=0):
        step *= 2
    while step and len(left):
        at = np.flatnonzero(n + step <= room)
        i, j = left[at] + n[at], right[at] + n[at]
        ok = (rolled(pattern, step)[i] == rolled(text, step)[j]) & (marked_p[i + step] == marked_p[i]) & (marked_t[j + step] == marked_t[j])
        n[at[ok]] += step
        step //= 2
    return n


def tile(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in pattern, start in text, length), none overlapping in either: always a longest common run
    of unmarked words; of several the first in the pattern, then in the text. Words are 64-bit hashes.

    Common runs are found for lengths that fall to `least`: all of a length or more wait in a queue, and what
    marking leaves of one goes back with its own length. Only first words of common runs are paired, so repeated
    words cost no more than the runs they form."""
    used_p, used_t = np.zeros(len(pattern), bool), np.zeros(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    length = least
    while 2 * length <= min(len(pattern), len(text)):
        length *= 2
    above = None
    while length >= least and len(pattern) - used_p.sum() >= least:
        t, p, start, times = _runs(pattern, text, used_p, used_t, length)
        if times.sum() > MOST_RUNS and above is not None and above - length > 1:
            length = (length + above) // 2  # fewer runs are as long as that
            continue
        above = length
        left = np.repeat(p, times)
        right = t[np.repeat(start, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        n = _extended(pattern, text, used_p, used_t, left, right, length)
        queue = [(-k, a, b) for k, a, b in zip(n.tolist(), left.tolist(), right.tolist(), strict=True) if k >= length]
        heapq.heapify(queue)
        while queue and len(pattern) - used_p.sum() >= least:
            k, a, b = heapq.heappop(queue)
            marked = used_p[a : a - k] | used_t[b : b - k] | (pattern[a : a - k] != text[b : b - k])  # words decide, not hashes
            if not marked.any():
                used_p[a : a - k] = used_t[b : b - k] = True
                tiles.append((a, b, -k))
                continue
            edge = np.flatnonzero(np.diff(np.r_[True, marked, True].astype(np.int8)))
            for s, e in edge.reshape(-1, 2).tolist():
                if e - s >= length:
                    heapq.heappush(queue, (s - e, a + s, b + s))
        length = length - 1 if length == least else max(least, length // 2)
    return tiles


class Index:
    """The items of one shard: their words as hashes, one after the other, and the places of their seeds."""

    def __init__(self, items: list[tuple[int, bytes]], least: int) -> None:
        self.least = least
        words = list(hashed(spaced(body) for _, body in items))
        some = [k for k, (lo, _) in enumerate(words) if len(lo)]
        self.ids = np.array([items[k][0] for k in some], np.int64)
        self.n = np.array([len(words[k][0]) for k in some], np.int64)
        self.begin = np.cumsum(self.n) - self.n
        self.words = np.concatenate([words[k][0] for k in some]) if some else np.empty(0, np.uint64)
        seeds = [rolled(self.pattern(k), least) for k in range(len(some))]
        flat = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.seeds = flat[order]
        self.item = np.repeat(np.arange(len(some), dtype=np.int32), list(map(len, seeds)))[order]
        self.place = np.concatenate([np.arange(len(s), dtype=np.int32) for s in seeds])[order] if seeds else np.empty(0, np.int32)
        #: items of fewer words, by length: their hash, and their number
        self.short = {m: (np.array([rolled(self.pattern(k), m)[0] for k in at], np.uint64), at) for m in range(1, least) if len(at := np.flatnonzero(self.n == m))}

    def pattern(self, k: int) -> np.ndarray:
        return self.words[self.begin[k] : self.begin[k] + self.n[k]]

    def candidates(self, text: np.ndarray, coverage: float) -> np.ndarray:
        """Items of which the seeds that the text holds could cover enough."""
        own = np.unique(rolled(text, self.least))
        begin, end = np.searchsorted(self.seeds, own), np.searchsorted(self.seeds, own, "right")
        begin, times = begin[end > begin], (end - begin)[end > begin]
        if not len(begin):
            return begin
        at = np.repeat(begin, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        places = np.unique(self.begin[self.item[at]] + self.place[at])  # in all items' words
        item = np.searchsorted(self.begin, places, "right") - 1
        reach = np.minimum(np.diff(places, append=places[-1:] + self.least), self.least)  # what a seed covers before the next one starts
        reach[:-1][item[1:] != item[:-1]] = self.least
        could = np.bincount(item, reach, len(self.n))
        return np.flatnonzero((could > 0) & (could >= coverage * self.n))

    def matches(self, text: np.ndarray, coverage: float) -> list[tuple[int, float, int, int]]:
        """(item, share of its words in tiles, tiles, words of the longest) for the items covered enough.
        An item of fewer than `least` words counts if the text holds it whole."""
        out = []
        for k in self.candidates(text, coverage).tolist():
            tiles = tile(self.pattern(k), text, self.least)
            share = sum(n for _, _, n in tiles) / int(self.n[k])
            if tiles and share >= coverage:
                out.append((int(self.ids[k]), share, len(tiles), max(n for _, _, n in tiles)))
        for m, (runs, at) in self.short.items():
            out += [(int(self.ids[k]), 1.0, 1, m) for k in at[np.isin(runs, rolled(text, m))].tolist()]
        return sorted(out)


def _shards(benchmark: DataFrame, least: int, item_id: str, text: str) -> Iterator[Index]:
    """Indexes of bounded size; the size of the benchmark is measured first."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("binary").alias("t")).filter("i is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    for k in range(shards):
        yield Index([(x.i, bytes(x.t)) for x in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k).sort("i", "t").toLocalIterator()], least)


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    return (lo for lo, _ in hashed(spaced(x.as_py()) for x in column.cast(pa.binary())))


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item covered enough: doc_id, item_id, coverage, n_tiles, longest_tile.

    Null texts match nothing; null or empty items are no items. Equal items and repeated rows are each reported.
    A null doc_id is reported as null. Bytes that are no UTF-8 count as U+FFFD. Other columns are ignored, whatever
    their names. An empty table on either side: no rows."""
    spark, rows, found = docs.sparkSession, docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("binary").alias("body")).filter("body is not null"), []
    for index in _shards(benchmark, least, item_id, item_text):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(doc.as_py(), *m) for doc, words in zip(batch.column("doc"), _texts(batch.column("body")), strict=True) for m in shared.value.matches(words, coverage)]
                doc, item, share, tiles, longest = zip(*out, strict=True) if out else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(share, pa.float64()), pa.array(tiles, pa.int32()), pa.array(longest, pa.int32())],
                    names=["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"],
                )

        found.append(rows.mapInArrow(tidy(run), "doc_id long, item_id long, coverage double, n_tiles int, longest_tile int"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text covers a benchmark item enough; their columns as they were, whatever their names.

    Rows with a null text stay, repeated rows stay or go together; an empty table on either side takes nothing away."""
    spark, place = docs.sparkSession, docs.columns.index(text)
    for index in _shards(benchmark, least, item_id, item_text):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.matches(words, coverage) for words in _texts(batch.column(place))], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
