"""N-gram Jaccard join with adaptive multi-match prefixes.

Every document is its set of word n-grams in one global order: those that occur once for certain first, then
by a coarse count, then by hash (both counts from a merged sketch, so the order is the same everywhere and
bounded in size). A pair similar enough shares at least l of the first n - t + l n-grams, for any l; each
document chooses the l of least estimated cost, from the counts along its prefix: a longer prefix is read
by more others but asks for more shared n-grams before a pair is verified. n-grams that occur once are never
sent.

Documents of one set are one class with one representative. Representatives that share a prefix n-gram
meet under the smallest of them (their hub), in blocks of bounded size that each hold the hub too, where the
candidates are counted by shared prefix n-grams and verified on their whole sets; a block returns a spanning
forest of its links rather than all pairs. Hubs with several blocks then compare, block by block, what is not yet connected to
the hub with all else, so that no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import boxed, checkpointed, hashed, mixed, release, text_size, tidy, unboxed, windows
from .components import roots

LEAST_BITS, MOST_BITS = 16, 29
#: Longest l that a document may choose, and the cost of a verification in reads of a posting.
MOST_MATCHES, VERIFY_COST = 4, 16.0
#: Hubs of several blocks up to this number are broadcast (a few MB).
MOST_LARGE = 200_000
#: Classes of more than this part of all rows are broadcast.
HOT = 1_000
#: n-grams and documents that a block holds at most (a single document may have more n-grams). Smaller blocks leave
#: more documents apart from their hub, and these are sent to all blocks of the hub.
BLOCK_NGRAMS, BLOCK_DOCS = 1_000_000, 2_048
#: n-grams in this many documents of a block are counted by matrix products, rarer ones pair by pair.
DENSE, CHUNK, CELLS = 24, 2_048, 1_000_000
#: Cells of a block whose n-grams are all counted by one product.
SMALL = 2_000_000
_SALTS = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)


def ngrams(bodies: Iterable[bytes], k: int) -> Iterator[np.ndarray]:
    """Distinct k-word n-grams (64-bit fingerprints, sorted) of each text, ASCII letters lower-cased."""
    for lo, hi in hashed(bodies, lower=True):
        yield np.unique(windows(lo, hi, min(k, len(lo)))[0]) if len(lo) else np.empty(0, np.uint64)


def _second(grams: np.ndarray) -> np.ndarray:
    return mixed(grams ^ _SALTS[0])


def _set_key(grams: np.ndarray) -> tuple[int, int]:
    return tuple(int(np.bitwise_xor.reduce(x) if i else x.sum(dtype=np.uint64)) for i, x in enumerate((mixed(grams ^ _SALTS[1]), _second(grams))))


def _least(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return -(-n * percent // 100)


def _ordered(grams: np.ndarray, counted: sketch.Merged) -> tuple[np.ndarray, np.ndarray]:
    level = counted.level(grams, _second(grams))
    order = np.lexsort((grams, level))
    return grams[order], level[order]


def _matches(levels: np.ndarray, least: int, background: float) -> int:
    """The l of least estimated cost: postings read, and at most their number over l candidates to verify."""
    n = len(levels)
    others = np.where(levels > 0, np.maximum(1.0, np.exp2(levels.astype(float) - 1) - background), 0.0)
    read = np.cumsum(others)
    choices = range(1, min(MOST_MATCHES, least) + 1)
    return min(choices, key=lambda m: (read[n - least + m - 1] * (1 + VERIFY_COST / m), m))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _arrow_lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


def _shared(rows: np.ndarray, grams: np.ndarray, m: int) -> np.ndarray:
    """How many n-grams each pair of the m documents shares (above the diagonal). rows, ascending, and grams are the
    postings; the matrices of a product hold at most CELLS postings and CHUNK n-grams at once."""
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    begin = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.empty(0, np.int64)
    length = np.append(begin, len(grams))[1:] - begin
    rows = rows[order].astype(np.int32)
    del order, grams
    begin, length = begin[length > 1], length[length > 1]
    out = np.zeros((m, m), np.float32)
    small = m * len(begin) <= SMALL
    heavy = np.flatnonzero(length > (1 if small else DENSE))
    s = 0
    while s < len(heavy):
        some = heavy[s : s + CHUNK]
        some = some[: max(1, int(np.searchsorted(np.cumsum(length[some]), CELLS)))]
        n = length[some]
        at = np.arange(n.sum()) + np.repeat(begin[some] - np.cumsum(n) + n, n)
        matrix = np.zeros((m, len(some)), np.float32)
        matrix[rows[at], np.repeat(np.arange(len(some), dtype=np.int32), n)] = 1
        out += matrix @ matrix.T
        s += len(some)
    for size in () if small else np.unique(length[length <= DENSE]).tolist():
        some = begin[length == size]
        for i in range(size):
            for j in range(i + 1, size):
                np.add.at(out, (rows[some + i], rows[some + j]), 1)
    return np.triu(out, 1)


def _forest(left: np.ndarray, right: np.ndarray, m: int) -> np.ndarray:
    label = np.arange(m)
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(table: pa.Table, percent: int) -> pa.Table:
    """Links of a block, as a spanning forest: candidates by shared prefix n-grams, verified on whole sets."""
    docs, matches = table["doc"].to_numpy(), table["matches"].to_numpy()
    sets = [np.frombuffer(x.as_py(), "<u8") for x in table["grams"]]
    order = np.argsort(docs, kind="stable")
    docs, matches, sets = docs[order], matches[order], [sets[i] for i in order]
    n, m = np.array([len(s) for s in sets]), len(sets)
    prefix = n - _least(n, percent) + matches
    seen = _shared(np.repeat(np.arange(m, dtype=np.int32), prefix), np.concatenate([s[:p] for s, p in zip(sets, prefix, strict=True)]), m)
    left, right = np.nonzero(seen)
    enough = seen[left, right] >= np.minimum(matches[left], matches[right])
    enough &= 100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right])
    left, right = left[enough], right[enough]
    del seen, enough
    if not len(left):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    some = np.unique(np.r_[left, right])
    place = np.zeros(m, np.int64)
    place[some] = np.arange(len(some))
    common = _shared(np.repeat(np.arange(len(some), dtype=np.int32), n[some]), np.concatenate([sets[i] for i in some]), len(some))[place[left], place[right]].astype(np.int64)
    linked = 100 * common >= percent * (n[left] + n[right] - common)
    label = _forest(left[linked], right[linked], m)
    del common, left, right, linked, sets
    child = np.flatnonzero((label != np.arange(m)) & (docs[label] != docs))
    return pa.table({"a": pa.array(docs[child], pa.int64()), "b": pa.array(docs[label[child]], pa.int64())})


_handled = 0


def _block(table: pa.Table, percent: int) -> pa.Table:
    """_compare; a worker gives memory back whenever its blocks add up to some hundred thousand n-grams."""
    global _handled
    out = _compare(table, percent)
    _handled += table["grams"].nbytes // 8
    if _handled > BLOCK_NGRAMS // 4:
        del table
        release()
        _handled = 0
    return out


def components(docs: DataFrame, k: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Two documents link when 100 * shared n-grams >= percent * all their n-grams. Words are runs of bytes other
    than ASCII white space; a text of fewer than k words is one n-gram; a null or empty text has none, links
    with nothing and is its own component. Rows of one doc_id count as one document with several texts.
    A null doc_id takes no part: its component is null. Other columns are ignored, whatever their names. Empty input:
    no rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("binary").alias("body"))
    _, size = text_size(rows, "body")
    bits = sketch.bits_for(size // 4, LEAST_BITS, MOST_BITS)

    def count(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for grams in ngrams((b.as_py() for b in batch.column("body")), k):
            if len(grams):
                yield grams, _second(grams)

    counted = sketch.merged(rows.filter("doc is not null and body is not null").select("body"), count, bits, 1)
    background = float(np.exp2(np.median(counted.levels).astype(float)))
    shared = spark.sparkContext.broadcast(counted)

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = shared.value
        for batch in batches:
            n, matches, lo, hi, sent = [], [], [], [], []
            for found in ngrams((b.as_py() or b"" for b in batch.column("body")), k):
                grams, levels = _ordered(found, counted)
                n.append(len(grams))
                if not len(grams):
                    matches.append(0), lo.append(0), hi.append(0), sent.append(np.empty(0, np.int64))
                    continue
                least = _least(len(grams), percent)
                matches.append(_matches(levels, least, background))
                first, second = _set_key(grams)
                lo.append(first), hi.append(second)
                prefix = len(grams) - least + matches[-1]
                sent.append(_signed(grams[:prefix][levels[:prefix] > 0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n, pa.int64()), pa.array(matches, pa.int32()), *(pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (lo, hi)), _arrow_lists(sent)],
                names=["doc", "n", "matches", "lo", "hi", "sent"],
            )

    nodes = checkpointed(rows.mapInArrow(tidy(publish), "doc long, n long, matches int, lo long, hi long, sent array<long>"))
    own = nodes.filter("doc is not null and n > 0").select("doc", "n", "lo", "hi", "sent")
    classes = own.groupBy("lo", "hi", "n").agg(F.min("doc").alias("rep"), F.count("*").alias("size"))
    reps = classes.select(F.col("rep").alias("doc")).distinct()
    named = _named(own.select("doc", "n", "lo", "hi"), classes, nodes.count())

    postings = own.select("doc", "n", "sent").join(reps, "doc", "left_semi").select("doc", "n", F.explode("sent").alias("gram"))
    hubs = postings.groupBy("gram").agg(F.min("doc").alias("hub"), F.max("doc").alias("last")).filter("hub < last").select("gram", "hub")
    members = postings.join(hubs, "gram").groupBy("hub", "doc").agg(F.max("n").alias("n"))
    members = checkpointed(members)
    totals = members.groupBy("hub").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_NGRAMS), F.ceil(F.count("*") / BLOCK_DOCS)).cast("long").alias("blocks"))
    large = checkpointed(totals.filter("blocks > 1"))
    placed = members.join(F.broadcast(large) if large.count() <= MOST_LARGE else large, "hub", "left").select("hub", "doc", F.pmod(F.xxhash64("doc"), F.coalesce("blocks", F.lit(1))).alias("block"))
    hub_everywhere = large.select("hub", F.col("hub").alias("doc"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    placed = placed.unionByName(hub_everywhere).distinct()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = shared.value
        for batch in batches:
            matches, out = [], []
            for found in ngrams((b.as_py() for b in batch.column("body")), k):
                grams, levels = _ordered(found, counted)
                matches.append(_matches(levels, _least(len(grams), percent), background) if len(grams) else 0)
                out.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(matches, pa.int32()), pa.array(out, pa.binary())], names=["doc", "matches", "grams"])

    needed = members.select("doc").distinct()
    sets = rows.filter("body is not null").join(needed.hint("shuffle_hash"), "doc", "left_semi").mapInArrow(tidy(whole), "doc long, matches int, grams binary").filter("matches > 0")
    links = checkpointed(
        placed.join(sets, "doc").select("hub", "block", "doc", "matches", "grams").groupBy("hub", "block").applyInArrow(lambda t: _block(t, percent), "a long, b long")
    )
    several = own.groupBy("doc").agg(F.count("*").alias("c")).filter("c > 1").select("doc")
    same = named.join(several, "doc", "left_semi").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    found = roots(links.unionByName(same))
    if large.head(1):
        links = links.unionByName(checkpointed(_across(members, large, found, sets, percent)))
        found = roots(links.unionByName(same))
    alone = nodes.filter("doc is null or n = 0").select("doc", "n", F.col("doc").alias("component_id"))
    rooted = named.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc", "n", F.coalesce("root", "rep").alias("component_id"))
    return rooted.unionByName(alone).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def _named(own: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """own (doc, n, lo, hi) with the representative of each row's class.

    Classes of more than a HOT-th of all rows are fewer than HOT, so these are broadcast: a text that a third of the
    rows share does not send them to one task. The others are joined by key."""
    key = ["lo", "hi", "n"]
    large = classes.filter(F.col("size") > max(1, total // HOT)).select(*key, F.col("rep").alias("hot"))
    marked = own.join(F.broadcast(large), key, "left")
    rest = marked.filter("hot is null").drop("hot").join(classes.select(*key, "rep"), key)
    return marked.filter("hot is not null").select("doc", "n", F.col("hot").alias("rep")).unionByName(rest.select("doc", "n", "rep"))


def _across(members: DataFrame, large: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For hubs of several blocks: blocks of the documents not yet connected to their hub, against all blocks."""
    size = lambda: F.greatest(F.ceil(F.sum("n") / BLOCK_NGRAMS), F.ceil(F.count("*") / BLOCK_DOCS)).cast("long")
    members = members.join(large.select("hub"), "hub")
    own = members.join(members.groupBy("hub").agg(size().alias("blocks")), "hub").join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    hub_roots = found.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    own = own.join(hub_roots, "hub", "left").withColumn("apart", F.col("root") != F.coalesce("hub_root", "hub"))
    apart = own.filter("apart")
    parts = apart.groupBy("hub").agg(size().alias("parts"))
    place = lambda n: F.pmod(F.xxhash64("doc"), F.col(n))
    every = own.join(parts, "hub").select("hub", "doc", place("blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    these = apart.join(parts, "hub").select("hub", "doc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), place("parts").alias("part"))
    both = every.select("hub", "part", "block", "doc").unionByName(these.select("hub", "part", "block", "doc")).distinct()
    return both.join(sets, "doc").select("hub", "part", "block", "doc", "matches", "grams").groupBy("hub", "part", "block").applyInArrow(lambda t: _block(t, percent), "a long, b long")


def kept(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the near copies: of each component the rows of the smallest doc_id stay, and of rows with one
    doc_id all stay. Rows with a null doc_id stay. All columns stay as they are, whatever their names. Empty input:
    no rows."""
    gone = components(docs, k, percent, doc_id, text).filter("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    own = docs.select(boxed(docs, docs.columns).alias("own"), F.col(f"`{doc_id}`").cast("long").alias("id"))
    return own.join(gone, "id", "left_anti").select(*unboxed(docs.columns))
