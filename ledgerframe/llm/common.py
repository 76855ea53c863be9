"""What the operators of this subpackage share: tables, checkpoints and word hashing."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Odd 64-bit multipliers for rolling fingerprints.
BASE_LO, BASE_HI = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> None:
    """Make sure that there is a checkpoint folder: the one the cluster names in spark.checkpoint.dir; a temporary one
    only where that is unset and the master is this machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow result, in the shared folder. For tables without texts only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def named(columns: list[str], added: Iterable[str]) -> list[str]:
    """The columns of a user's table that stay when `added` come to it; names differ by more than case."""
    taken = {c.lower() for c in added}
    return [c for c in columns if c.lower() not in taken]


def boxed(docs: DataFrame, columns: list[str]) -> Column:
    """A user's columns as one struct with fields by number, so that their names meet no others."""
    return F.struct(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns))) if columns else F.struct(F.lit(None).cast("int").alias("_"))


def unboxed(columns: list[str], box: str = "own") -> list[Column]:
    return [F.col(f"{box}._{i}").alias(c) for i, c in enumerate(columns)]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, wherever it is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, settle: Callable[[str], Column], most: int, learn: str = "true") -> DataFrame:
    """id, y and body (bytes, null: empty) of labelled documents, at most `most` of them: those of least hash of their
    ids. Written once, as a fit reads it more than once: its size is bounded by `most`, not by the data.

    settle decides between labels of one document; labels other than 0 and 1 do not count; learn (SQL on id) tells
    which ids may be used; of rows with one id the text of least hash is taken."""
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("double").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.filter(learn).groupBy("id").agg(settle("y").cast("int").alias("y")).sort(F.xxhash64("id"), "id").limit(most)
    body = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), body.alias("body")).join(F.broadcast(known), "id")
    return checkpointed(rows.groupBy("id", "y").agg(F.min_by("body", F.xxhash64("body")).alias("body")))


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_size(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows, and bytes of text: one narrow pass whose two sums are all that reaches the driver."""
    row = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(column).cast("long")).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def release() -> None:
    """Give memory that a task no longer needs back to the system: Python workers are reused, and what one stage
    leaves counts against the next."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with release() when it ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, the bits of others become independent."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_A
    x ^= x >> np.uint64(33)
    x = x * MIX_B
    x ^= x >> np.uint64(33)
    return x


#: Bytes of text that are hashed at once, and bytes of a word beyond which it is hashed on its own.
CHUNK_BYTES, LONG_WORD = 1 << 20, 64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20_240_607)
_BYTES = _RANDOM.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RANDOM.integers(0, 1 << 63, (2, LONG_WORD), np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def hash_words(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and two independent 64-bit hashes of the words of data: sums over its bytes of a random number of the
    byte times one of its place (multilinear, so any two words collide with the chance of random ones)."""
    white = np.r_[True, _WHITE[data], True]
    edges = np.flatnonzero(white[1:] != white[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64), np.empty(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    inside = data[~white[1:-1]]
    long = np.flatnonzero(lengths > LONG_WORD)
    if len(long):
        place = np.minimum(place, LONG_WORD - 1)
    out = []
    for k in range(2):
        values = (_BYTES[k][_LOWER] if lower else _BYTES[k])[inside]
        values *= _PLACES[k][place]
        out.append(np.add.reduceat(values, first))
    for i in long.tolist():
        word = data[starts[i] : starts[i] + lengths[i]].tobytes()
        value = xxhash.xxh3_128_intdigest(word.lower() if lower else word)
        out[0][i], out[1][i] = value & 0xFFFFFFFFFFFFFFFF, value >> 64
    return starts, mixed(out[0]), mixed(out[1])


def hashed(bodies: Iterable[bytes], lower: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the 128-bit hashes (two arrays) of its words, runs of bytes other than ASCII white space, with
    ASCII letters lower-cased if asked for. Short texts are hashed together."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts, lo, hi = hash_words(np.frombuffer(b" ".join(held), np.uint8), lower)
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(b) + 1 for b in held])).tolist()
        yield from ((lo[s:e], hi[s:e]) for s, e in zip(bounds, bounds[1:], strict=False))

    for body in bodies:
        held.append(body)
        size += len(body)
        if size >= CHUNK_BYTES:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def windows(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit fingerprints of every run of `length` words, as two independent rolling polynomials."""
    n = len(lo) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(length):
        a *= BASE_LO
        a += lo[j : j + n]
        b *= BASE_HI
        b += hi[j : j + n]
    return mixed(a), mixed(b)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """True for the words of a text of n words that lie in a window starting at one of `starts`."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:-1]) > 0


def rolling_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of `width` values."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values = np.minimum(values[: len(values) - step], values[step:])
        reach += step
    return values
