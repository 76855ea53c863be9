"""Suffix-array dedup over sparse suffixes.

Of every text the suffixes are retained that start at content-selected positions (minimisers): in each run of
`length` words the one whose next `length // 2` words (its core) have the smallest hash. Two equal runs
retain the same suffix, so nothing is lost.

A first pass sorts the retained suffixes by fingerprints of their cores alone and drops those whose neighbours
there are of no other document. The others form the suffix array: dealt by their cores, sorted by their words
and compared with their neighbours, which gives the common prefixes. The same is done with the words to their
left, read backwards, which tells how far a match extends to the left. Where a suffix and one of an earlier
document agree in `length` words, left and right extension together, the run is a repeat; the runs of the
suffixes next to it continue it to its full extent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hashed, mixed, text_size, tidy, windows
from .repeats import Found, buckets_for, by_row, exchanged, gathered, hot_places, later, meeting, pack, starts_of, unpack
from .substring_dedup import keyed, with_removals

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SALT = np.uint64(0xA0761D6478BD642F)
_ZSTD = zstandard.ZstdCompressor(level=1)

#: A core that starts so many suffixes is hot: its suffixes are not sorted in one place, but their runs, 26 at
#: most, are grouped each by itself. The number grows with the input so that fewer than MOST_HOT cores are hot.
HOT, MOST_HOT = 20_000, 8_000_000
#: Bytes of suffixes that a task holds before it sends them, and that are sorted at once.
FLUSH_BYTES, SLICE_BYTES = 24_000_000, 6_000_000
_SENT = "bucket int, hot int, text binary, core binary, doc binary, shape binary, entry binary, row binary, at binary, lo binary, hi binary, done_doc long, done_row long"
_COLUMNS = [x.split()[0] for x in _SENT.split(", ")]
_KINDS = [{"int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}[x.split()[1]] for x in _SENT.split(", ")]


def selected(lo: np.ndarray, length: int) -> np.ndarray:
    """For each run of `length` words the start of the suffix it retains, from the hashes of the cores."""
    width = length - length // 2 + 1
    value = mixed(lo ^ _SALT)
    if len(value) < width:
        return np.empty(0, np.int64)
    best, reach = np.arange(len(value)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(value[left] <= value[right], left, right)
        reach += step
    return best


def _common(sorted_words: np.ndarray) -> np.ndarray:
    """Words that each row has in common with the row before it (0 for the first)."""
    out = np.zeros(len(sorted_words), np.int64)
    apart = sorted_words[1:] != sorted_words[:-1]
    out[1:] = np.where(apart.any(axis=1), apart.argmax(axis=1), sorted_words.shape[1])
    return out


def _array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their words, first word first, and the common prefix of neighbours."""
    order = np.argsort(np.ascontiguousarray(words.astype(">u8")).view(f"S{8 * words.shape[1]}").ravel(), kind="stable")
    return order, _common(words[order])


def repeats_of(words: np.ndarray, n: np.ndarray, left: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes, each with what lies to its left, as hashes of words one after the other: n words each, of which the
    first `left` lie before the suffix. Returns numbers of suffixes and the words to their left at which a run of
    `length` words starts that a smaller document also has."""
    reach = length - length // 2
    first = np.cumsum(n) - n

    def window(start: np.ndarray, step: int, width: int, have: np.ndarray) -> np.ndarray:
        j = np.arange(width)
        at = np.where(j < have[:, None], start[:, None] + step * j, 0)
        return np.where(j < have[:, None], words[at], np.uint64(0))

    order, common = _array(window(first + left, 1, length, n - left))
    back_order, back_common = _array(window(first + left - 1, -1, reach, left))
    prefix, back = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
    found: list[np.ndarray] = []
    extent: list[np.ndarray] = []
    for k in range(reach + 1):  # words of the run to the left of the suffix
        fits = np.flatnonzero((left >= k) & (n - left >= length - k))
        if not len(fits):
            continue
        prefix[order] = np.cumsum(common < length - k)  # equal numbers: equal in the first length - k words
        back[back_order] = np.cumsum(back_common < k) if k else 0
        key = prefix[fits] * (len(n) + 1) + back[fits]
        ordered = np.lexsort((doc[fits], key))
        new = starts_of(key[ordered])
        least = doc[fits][ordered][new][np.cumsum(new) - 1]
        late = fits[ordered][doc[fits][ordered] > least]
        found.append(late)
        extent.append(np.full(len(late), k))
    return (np.concatenate(found), np.concatenate(extent)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


class _Held:
    """Suffixes of a task, equal ones once, until they are sent."""

    def __init__(self, length: int, buckets: int) -> None:
        self.length, self.buckets = length, buckets
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.core: list[int] = []
        self.entries: list[tuple[int, int, int, int]] = []
        self.hot: list[Found] = []
        self.size = 0

    def add(self, left: int, text: bytes, core: int, doc: int, row: int, at: int) -> None:
        key = left.to_bytes(2, "big") + text
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.core)
            self.core.append(core)
            self.size += len(key)
        self.size += 16
        self.entries.append((number, doc, row, at))

    def add_hot(self, found: Found) -> None:
        self.hot.append(found)
        self.size += 40 * len(found[2])

    def _settled(self, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        done = by_row(doc, row, at)
        return self._batch({"bucket": [-1] * done.num_rows, "at": done["at"], "done_doc": done["doc"], "done_row": done["row_key"]})

    @staticmethod
    def _batch(given: dict) -> pa.RecordBatch:
        n = len(given["bucket"])
        return pa.RecordBatch.from_arrays([pa.array(given[c], k) if c in given else pa.nulls(n, k) for c, k in zip(_COLUMNS, _KINDS, strict=True)], names=_COLUMNS)

    def sent(self) -> Iterator[pa.RecordBatch]:
        if self.entries:
            number, doc, row, at = np.array(self.entries, np.int64).T
            texts = list(self.numbers)
            left = np.array([int.from_bytes(t[:2], "big") for t in texts], np.int64)
            n = np.array([t.count(b" ", 2) + 1 for t in texts], np.int64)
            least = np.full(len(texts), np.iinfo(np.int64).max)
            np.minimum.at(least, number, doc)
            late = doc > least[number]
            if late.any():  # equal suffixes of larger documents: all their runs are repeats
                runs = (n - self.length + 1)[number[late]]
                place = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
                yield self._settled(np.repeat(doc[late], runs), np.repeat(row[late], runs), np.repeat(at[late], runs) + place)
            number, row, at = number[~late], row[~late], at[~late]
            core = np.array(self.core, np.uint64)
            bucket = (mixed(core) % np.uint64(self.buckets)).astype(np.int64)
            order = np.argsort(bucket[number], kind="stable")
            cuts = np.flatnonzero(starts_of(bucket[number][order]))
            out: dict[str, list] = {c: [] for c in ("bucket", "hot", "text", "core", "doc", "shape", "entry", "row", "at")}
            for s, e in zip(cuts, np.append(cuts, len(order))[1:], strict=True):
                own = order[s:e]
                used, entry = np.unique(number[own], return_inverse=True)
                out["bucket"].append(int(bucket[used[0]]))
                out["hot"].append(0)
                out["text"].append(_ZSTD.compress(b"\n".join(texts[i][2:] for i in used)))
                out["core"].append(core[used].tobytes())
                out["doc"].append(pack(least[used]))
                out["shape"].append(_ZSTD.compress(np.c_[left[used], n[used]].astype("<u2").tobytes()))
                out["entry"].append(pack(entry.astype("<i8")))
                out["row"].append(pack(row[own]))
                out["at"].append(pack(at[own]))
            if out["bucket"]:
                yield self._batch(out)
        if self.hot:
            n = [len(x[2]) for x in self.hot]
            row, doc = np.repeat(np.array([x[0] for x in self.hot], np.int64), n), np.repeat(np.array([x[1] for x in self.hot], np.int64), n)
            lo, hi, at = (np.concatenate([x[k] for x in self.hot]) for k in (2, 3, 4))
            late = later(lo, hi, doc)
            if late.any():
                yield self._settled(doc[late], row[late], at[late])
            row, doc, lo, hi, at = (x[~late] for x in (row, doc, lo, hi, at))
            bucket = (mixed(lo) % np.uint64(self.buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(starts_of(bucket[order]))
            parts = [order[s:e] for s, e in zip(cuts, np.append(cuts, len(order))[1:], strict=True)]
            yield self._batch({
                "bucket": [int(bucket[p[0]]) for p in parts], "hot": [1] * len(parts), "doc": [pack(doc[p]) for p in parts], "row": [pack(row[p]) for p in parts],
                "at": [pack(at[p].astype("<i8")) for p in parts], "lo": [lo[p].tobytes() for p in parts], "hi": [hi[p].tobytes() for p in parts],
            })
        self.clear()


def _meet(table: pa.Table, length: int) -> pa.Table:
    """The suffix array of a bucket, cut into slices of whole cores so that few are held as words at once."""
    out: list[pa.RecordBatch] = []
    rows = table.to_pylist()
    hot = [r for r in rows if r["hot"]]
    if hot:
        lo, hi = (np.frombuffer(b"".join(r[c] for r in hot), "<u8") for c in ("lo", "hi"))
        doc, row, at = (np.concatenate([unpack(r[c], "<i8") for r in hot]) for c in ("doc", "row", "at"))
        late = later(lo, hi, doc)
        out.append(by_row(doc[late], row[late], at[late]))
    rows = [r for r in rows if not r["hot"]]
    if rows:
        texts = [t for r in rows for t in zstandard.decompress(r["text"]).split(b"\n")]
        count = [len(r["core"]) // 8 for r in rows]
        core = np.frombuffer(b"".join(r["core"] for r in rows), "<u8")
        shape = np.frombuffer(b"".join(zstandard.decompress(r["shape"]) for r in rows), "<u2").astype(np.int64).reshape(-1, 2)
        doc = np.concatenate([unpack(r["doc"], "<i8") for r in rows])
        entry = np.concatenate([unpack(r["entry"], "<i8") + s for r, s in zip(rows, np.cumsum(count) - count, strict=True)])
        row, at = (np.concatenate([unpack(r[c], "<i8") for r in rows]) for c in ("row", "at"))
        by = np.argsort(entry, kind="stable")
        begin = np.searchsorted(entry[by], np.arange(len(texts) + 1))
        slices = -(-sum(map(len, texts)) // SLICE_BYTES)
        place = (mixed(core ^ _SALT) % np.uint64(slices)).astype(np.int64)
        for k in range(slices):
            own = np.flatnonzero(place == k)
            if len(own) < 2:
                continue
            n, left = shape[own, 1], shape[own, 0]
            words = np.concatenate([lo for lo, _ in hashed(texts[i] for i in own)])
            found, extent = repeats_of(words, n, left, doc[own], length)
            times = (begin[1:] - begin[:-1])[own][found]
            each = np.repeat(begin[:-1][own][found], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            start = np.repeat(left[found] - extent, times)
            out.append(by_row(np.repeat(doc[own][found], times), row[by[each]], at[by[each]] + start))
    return pa.Table.from_batches(out, schema=pa.schema([("doc", pa.int64()), ("row_key", pa.int64()), ("at", pa.binary())]))


def repeated_runs(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, row_key, late_at: first words of the runs of `length` words that a document with a smaller id also holds.

    Null ids and null texts take no part; rows with the same id do not count against each other."""
    rows = keyed(docs, doc_id, text).filter("doc is not null and body is not null")
    _, size = text_size(rows, "body")
    core, buckets = length // 2, buckets_for(size)
    hot_from = max(HOT, size // 64 // MOST_HOT)  # a suffix for 64 bytes of text or more

    def suffixes(batch: pa.RecordBatch) -> Iterator[Found]:
        for key, doc, words in zip(batch.column("row_key"), batch.column("doc"), hashed(b.as_py() for b in batch.column("body")), strict=True):
            if len(words[0]) >= length:
                lo, hi = windows(*words, core)
                at = np.unique(selected(lo, length))
                yield key.as_py(), doc.as_py(), lo[at], hi[at], at.astype("<u4"), lo[at]

    met = checkpointed(meeting(rows, suffixes, size // 2, hot_from))  # narrow: places, and the hot cores
    common = b"".join(r["at"] for r in hot_places(met).toLocalIterator())  # 8 bytes each of MOST_HOT at most
    hot_cores = docs.sparkSession.sparkContext.broadcast(np.unique(np.frombuffer(common, "<u8")))
    anchors = gathered(met).withColumnRenamed("late_at", "anchors")
    anchored = rows.join(anchors.hint("shuffle_hash"), ["doc", "row_key"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(length, buckets)
        for batch in batches:
            bodies = [b.as_py() for b in batch.column("body")]
            for body, key, doc, anchors, (lo, hi) in zip(bodies, *(batch.column(c) for c in ("row_key", "doc", "anchors")), hashed(bodies), strict=True):
                key, doc = key.as_py(), doc.as_py()
                is_anchor = np.zeros(len(lo), bool)
                is_anchor[np.frombuffer(b"".join(anchors.as_py()), "<u4")] = True
                cores = windows(lo, hi, core)[0]
                kept = selected(cores, length)
                begin = np.flatnonzero(starts_of(kept))  # the runs that retain one suffix follow each other
                end = np.append(begin, len(kept))[1:] - 1
                some = is_anchor[kept[begin]]
                begin, end = begin[some], end[some]
                suffix = kept[begin]
                hot = np.isin(cores[suffix], hot_cores.value) if len(hot_cores.value) else np.zeros(len(suffix), bool)
                words = body.split() if not hot.all() else []
                for p, b, e, c in zip(*(x[~hot].tolist() for x in (suffix, begin, end)), cores[suffix[~hot]].tolist(), strict=True):
                    held.add(p - b, b" ".join(words[b : e + length]), c, doc, key, b)
                if hot.any():
                    whole_lo, whole_hi = windows(lo, hi, length)
                    at = np.concatenate([np.arange(b, e + 1) for b, e in zip(begin[hot], end[hot], strict=True)])
                    held.add_hot((key, doc, whole_lo[at], whole_hi[at], at, at))
                if held.size >= FLUSH_BYTES:
                    yield from held.sent()
        yield from held.sent()

    return gathered(exchanged(anchored.mapInArrow(tidy(extend), _SENT), buckets, lambda t: _meet(t, length)))


def spans(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each maximal repeated passage: doc_id, first_word and n_words, within the words of the text.

    Words are runs of bytes other than ASCII white space. A passage is the union of the runs of at least
    `length` words that a smaller doc_id also holds; texts of fewer words have none. Repeated rows (equal id
    and text) are reported once; null ids and texts, not at all. Other columns are ignored, whatever their names.
    Empty input: no rows."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, first, n = [], [], []
            for one, late_at in zip(batch.column("doc"), batch.column("late_at"), strict=True):
                at = np.unique(np.frombuffer(b"".join(late_at.as_py()), "<u4").astype(np.int64))
                begin = np.flatnonzero(np.diff(at, prepend=-length - 1) > length)
                end = np.append(begin, len(at))[1:] - 1
                doc += [one.as_py()] * len(begin)
                first += at[begin].tolist()
                n += (at[end] + length - at[begin]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "first_word", "n_words"])

    return repeated_runs(docs, length, doc_id, text).mapInArrow(tidy(merge), "doc_id long, first_word long, n_words long")


def without_repeats(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated passages cut out of their texts; the rest of a text stays as it is, and what a
    cut separates is joined by one space. A text without repeats is unchanged, a null text stays null. All other
    columns stay as they are, whatever their names. Empty input: no rows."""

    def finish(body: bytes | None, words: list[bytes], gone: np.ndarray) -> tuple[str | None]:
        if body is None or not gone.any():
            return (None if body is None else body.decode("utf-8", "replace"),)
        places = [m.span() for m in _WORD.finditer(body)]
        edge = np.diff(np.r_[True, gone, True].astype(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1) - 1
        parts = [body[0 if b == 0 else places[b][0] : len(body) if e == len(places) - 1 else places[e][1]] for b, e in zip(begin, end, strict=True)]
        return (b" ".join(parts).decode("utf-8", "replace"),)

    return with_removals(docs, repeated_runs(docs, length, doc_id, text), length, doc_id, text, "text string", finish, replaced=text)
