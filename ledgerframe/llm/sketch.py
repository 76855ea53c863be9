"""Count-min sketches built per partition and merged page by page.

A sketch has `depth` rows of 2**bits counters, cut into pages of 65,536. Each task counts the cells that
its own keys hit and sends one row per page and flush; equal pages are summed in a shuffle, so no task
and no driver holds the sketch of another page. What is kept of the merged counters is bounded by the
parameters, not by the data: one bit a cell (hit at least twice) and, if asked for, coarse levels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import MIX_A, default_partitions, mixed, tidy

PAGE = 1 << 16
#: Keys that a task gathers before it sends their counts.
FLUSH_KEYS = 4_000_000
#: Cells that share one coarse count.
COARSE = 1 << 7
_ZSTD = zstandard.ZstdCompressor(level=1)
_SENT = "n int, page int, cells binary, more binary, counts binary"


def bits_for(keys: int, least: int, most: int) -> int:
    """Bits of a row so that there are at least as many cells as keys, within fixed bounds."""
    return min(most, max(least, int(max(1, keys) - 1).bit_length()))


def cells(lo: np.ndarray, hi: np.ndarray, bits: int, depth: int) -> list[np.ndarray]:
    """The cell of each key in each row."""
    shift = np.uint64(64 - bits)
    return [(lo if r == 0 else hi if r == 1 else mixed(lo ^ MIX_A * np.uint64(r))) >> shift for r in range(depth)]


def _packed(offsets: np.ndarray) -> bytes:
    """Ascending 16-bit offsets as steps: all low bytes, then the high bytes, few of them not zero, compressed."""
    steps = np.diff(offsets, prepend=np.uint16(0))
    return (steps & 0xFF).astype(np.uint8).tobytes() + _ZSTD.compress((steps >> 8).astype(np.uint8).tobytes())


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    high = np.frombuffer(zstandard.decompress(packed[n:]), np.uint8).astype(np.int64)
    return np.cumsum(np.frombuffer(packed[:n], np.uint8) + (high << 8))


def _pages(gathered: list[np.ndarray], bits: int, row: int) -> Iterator[dict]:
    every = np.concatenate(gathered)
    gathered.clear()
    every.sort()
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    counts = np.diff(first, append=len(every))
    found = every[first]
    del every, first
    page, offset = found >> np.uint32(16), (found & np.uint32(PAGE - 1)).astype("<u2")
    starts = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
    for s, e in zip(starts, np.r_[starts[1:], len(page)], strict=True):
        many = counts[s:e] > 1
        yield {
            "n": int(e - s),
            "page": int(page[s]) + (row << max(0, bits - 16)),
            "cells": _packed(offset[s:e]),
            "more": offset[s:e][many].tobytes(),
            "counts": counts[s:e][many].astype("<u4").tobytes(),
        }


@dataclass(frozen=True)
class Merged:
    """Bounded to 2**bits / 8 bytes a row, and 2**bits / COARSE bytes of levels."""

    bits: int
    rows: tuple[np.ndarray, ...]
    levels: np.ndarray

    def repeated(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """True for keys whose estimated count is two or more: for every key that does occur twice, and some others."""
        out = np.ones(len(lo), bool)
        for row, cell in zip(self.rows, cells(lo, hi, self.bits, len(self.rows)), strict=True):
            out &= (row[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return out

    def level(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """0 for keys that occur once for certain, else 1 + the binary logarithm of a coarse count of the first row."""
        coarse = self.levels[cells(lo, hi, self.bits, 1)[0] // np.uint64(COARSE)]
        return np.where(self.repeated(lo, hi), coarse, 0).astype(np.uint8)


def merged(source: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], bits: int, depth: int) -> Merged:
    """Count the 128-bit keys (two arrays each time) that `keys` finds in each Arrow batch of source."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[list[np.ndarray]] = [[] for _ in range(depth)]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for r in range(depth):
                if gathered[r]:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(list(_pages(gathered[r], bits, r))).astype({"n": "int32", "page": "int32"}), preserve_index=False)

        for batch in batches:
            for lo, hi in keys(batch):
                for r, cell in enumerate(cells(lo, hi, bits, depth)):
                    gathered[r].append(cell.astype(np.uint32))
                size += len(lo)
                if size >= FLUSH_KEYS:
                    yield from flush()
                    size = 0
        yield from flush()

    pages_a_row = max(1, (1 << bits) // PAGE)
    width = min(PAGE, 1 << bits)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for one in table.select(["n", "cells", "more", "counts"]).to_pylist():
            total[_unpacked(one["cells"], one["n"])] += 1
            total[np.frombuffer(one["more"], "<u2")] += np.frombuffer(one["counts"], "<u4").astype(np.int64) - 1
        bit = np.packbits(total > 1, bitorder="little").tobytes()
        coarse = total.reshape(-1, COARSE).sum(axis=1)
        level = (1 + np.log2(np.maximum(coarse, 1))).astype(np.uint8).tobytes()
        return pa.table({"page": pa.array([table["page"][0].as_py()], pa.int32()), "bit": [bit], "level": [level]})

    # Dealt by groups of pages; a page is a fixed 65,536 counters whatever the input.
    done = source.mapInArrow(tidy(count), _SENT).repartition(default_partitions(source.sparkSession), "page").groupBy("page").applyInArrow(add, "page int, bit binary, level binary")
    rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(depth)]
    levels = np.ones((1 << bits) // COARSE, np.uint8)
    # Bounded by the parameters: at most depth * 2**bits / 8 bytes in all, fetched partition by partition.
    for one in done.toLocalIterator(prefetchPartitions=True):
        r, page = divmod(one["page"], pages_a_row)
        rows[r][page * width // 8 : (page + 1) * width // 8] = np.frombuffer(one["bit"], np.uint8)
        if r == 0:
            levels[page * width // COARSE : (page + 1) * width // COARSE] = np.frombuffer(one["level"], np.uint8)
    return Merged(bits, tuple(rows), levels)


