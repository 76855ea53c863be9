"""Periodic runs of words by Stoye and Gusfield's traversal of the suffix tree.

A run is a stretch of words with a smallest period that no neighbouring word extends. Its last square is branching: the
two suffixes a period apart part right after it, so they lie under different children of the tree node whose depth is the
period. Going through the tree, only the leaves of the smaller side of each node are looked up, a period ahead and a
period back, which finds every branching square in n log n steps. Rotating squares to the left gives the runs.

The tree is held as arrays: suffixes in order (by prefix doubling), common prefixes of neighbours, and for each of these
the leaves on both sides of it. Words of which no neighbourhood of eight occurs twice in a text are in no run, so most
texts need no tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import boxed, hashed, named, tidy, unboxed, windows

#: A run has this many words at least, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the neighbourhoods that are looked for. In a run of 24 words and three periods each stretch of eight occurs
#: again one period ahead or back.
NEAR = 8
#: Leaves that are looked up at once.
LEAVES = 1 << 20

Run = tuple[int, int, int]


def _repeated(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words (first, end) in which every NEAR words in a row occur twice in the text: all runs lie within."""
    if len(lo) < LEAST_WORDS:
        return []
    near = windows(lo, hi, NEAR)[0]
    order = np.argsort(near)
    same = np.append(False, near[order][1:] == near[order][:-1])
    twice = np.zeros(len(near) + 2, np.int8)
    twice[1 + order[same | np.append(same[1:], False)]] = 1
    edges = np.flatnonzero(np.diff(twice))
    return [(s, e + NEAR - 1) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if e - s + NEAR - 1 >= LEAST_WORDS]


class _Tree:
    """The suffix tree of an array of numbers as arrays: `sa`, the suffixes in order, and `lcp`, the length of the prefix
    that each shares with the next. Ranks by their first 1, 2, 4... numbers are kept: four bytes a number and doubling."""

    def __init__(self, s: np.ndarray) -> None:
        self.n = n = len(s)
        rank = np.unique(s, return_inverse=True)[1].astype(np.int32)
        self._levels, h = [rank], 1
        while True:
            key = rank.astype(np.int64) * (n + 1)
            key[: n - h] += rank[h:] + 1
            order = np.argsort(key)
            new = np.append(False, key[order][1:] != key[order][:-1])
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(new)
            if new.sum() == n - 1:
                break
            self._levels.append(rank)
            h *= 2
        self.sa, self.rank = order, rank
        self.lcp = self.common(order[:-1], order[1:])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers the suffixes at i and j (different ones) share."""
        i, j, out = i.astype(np.int64), j.astype(np.int64), np.zeros(len(i), np.int64)
        for k in range(len(self._levels) - 1, -1, -1):
            level = self._levels[k]
            step = (np.maximum(i, j) < self.n) & (level[np.minimum(i, self.n - 1)] == level[np.minimum(j, self.n - 1)])
            move = step.astype(np.int64) << k
            i, j, out = i + move, j + move, out + move
        return out

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place between neighbours the first and the last leaf of the node that parts them there. A node with
        more than two children is parted one after another."""
        lcp = self.lcp.tolist()
        first, last = [0] * len(lcp), [len(lcp)] * len(lcp)
        stack: list[int] = []
        for k, depth in enumerate(lcp):
            while stack and lcp[stack[-1]] > depth:
                last[stack.pop()] = k
            first[k] = stack[-1] + 1 if stack else 0
            stack.append(k)
        return np.array(first), np.array(last)

    def branching_squares(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and periods of all squares whose last word is not repeated a period on."""
        first, last = self.sides()
        at = np.flatnonzero((self.lcp > 0) & (self.lcp <= self.n // LEAST_PERIODS))
        first, last, period = first[at], last[at], self.lcp[at]
        left = at - first + 1 <= last - at  # the smaller side
        begin, end = np.where(left, first, at + 1), np.where(left, at + 1, last + 1)
        low, high = np.where(left, at + 1, first), np.where(left, last, at)  # the other one
        sizes = end - begin
        ends = np.cumsum(sizes)
        s = 0
        while s < len(at):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + LEAVES, "right")))
            node = np.repeat(np.arange(s, e), sizes[s:e])
            leaf = np.arange(len(node)) - np.repeat(np.cumsum(sizes[s:e]) - sizes[s:e], sizes[s:e]) + begin[node]
            i, p = self.sa[leaf], period[node]
            for j, start in ((i + p, i), (i - p, i - p)):
                there = self.rank[np.clip(j, 0, self.n - 1)]
                found = (j >= 0) & (j < self.n) & (there >= low[node]) & (there <= high[node])
                yield start[found], p[found]
            s = e


def _leftmost(s: np.ndarray, at: int, period: int) -> int:
    """The first place from which numbers up to `at` equal those a period on: all rotations to the left, in strides."""
    stride = 64
    while at > 0:
        low = max(0, at - stride)
        other = np.flatnonzero(s[low:at] != s[low + period : at + period])
        if len(other):
            return low + int(other[-1]) + 1
        at, stride = low, stride * 2
    return 0


def runs_of(s: np.ndarray) -> list[Run]:
    """start, length and smallest period of all runs of an array of numbers, by start and period."""
    if len(s) < LEAST_WORDS:
        return []
    tree = _Tree(s)
    ends: dict[int, list[int]] = {}
    for start, period in tree.branching_squares():
        more = np.maximum(LEAST_WORDS - 2 * period, (LEAST_PERIODS - 2) * period)  # words before the square that a run needs
        enough = start >= more
        start, period, more = start[enough], period[enough], more[enough]
        long = tree.common(start - more, start - more + period) >= more + period
        for e, p in zip((start + 2 * period)[long].tolist(), period[long].tolist(), strict=True):
            ends.setdefault(e, []).append(p)
    out = []
    for end, periods in ends.items():
        own: list[Run] = []
        for p in sorted(set(periods)):
            if any(p % q == 0 and length >= 2 * p for _, length, q in own):
                continue  # the same run, by a multiple of its period
            start = _leftmost(s, end - 2 * p, p)
            own.append((start, end - start, p))
        out += own
    return sorted(out, key=lambda r: (r[0], r[2]))


def found_in(words: list[bytes], stretches: list[tuple[int, int]]) -> list[Run]:
    """The runs of words within stretches, each of which is followed by a number of its own."""
    ids: dict[bytes, int] = {}
    parts, places, offset = [], [], 0
    for k, (s, e) in enumerate(stretches):
        parts.append(np.array([ids.setdefault(w, len(ids)) for w in words[s:e]] + [-1 - k], np.int64))
        places.append((offset, s))
        offset += e - s + 1
    starts = np.array([p[0] for p in places])
    out = []
    for start, length, period in runs_of(np.concatenate(parts)):
        at, first = places[int(np.searchsorted(starts, start, "right")) - 1]
        out.append((start - at + first, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


_RUNS = ArrayType(StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")]))


def detected(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds to all columns of docs: `runs`, an array of start (word number from 0), length and smallest period, by start and
    period, and `collapsed`, the words that remain if each run keeps its first period only, joined by single spaces.

    Words are runs of characters other than ASCII white space. A run has LEAST_WORDS words and LEAST_PERIODS periods at
    least. Null and empty texts have no runs and collapse to an empty one; texts of any length are taken whole (a tree takes
    some hundred bytes a word of the stretches that are looked at). Rows are independent: ties and repeated rows need no
    rule. Columns named as the added ones, in any case, are replaced; all others stay. Empty input: no rows."""
    kept = named(docs.columns, ("runs", "collapsed"))
    source = docs.select(boxed(docs, kept).alias("own"), F.col(f"`{text}`").cast("binary").alias("value"))
    form = StructType([source.schema["own"], StructField("runs", _RUNS), StructField("collapsed", StringType())])
    kind = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [x.as_py() or b"" for x in batch.column("value")]
            found, texts = [], []
            for body, (lo, hi) in zip(bodies, hashed(bodies), strict=True):
                words = body.split()
                stretches = _repeated(lo, hi)
                runs = found_in(words, stretches) if stretches else []
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                texts.append(b" ".join(collapsed_words(words, runs) if runs else words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(found, kind), pa.array(texts, pa.string())], names=["own", "runs", "collapsed"])

    return source.mapInArrow(tidy(run), form).select(*unboxed(kept), "runs", "collapsed")
