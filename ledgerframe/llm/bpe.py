"""Byte-level BPE through a sentencepiece model that is written, not trained.

The model file is serialised straight from a rank vocabulary: each token's bytes are mapped to one
printable character per byte, its score is its negative rank, and normalisation is the identity. A text
is split into pre-tokens, each of which the model merges on its own; decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import boxed, named, tidy, unboxed

#: Pre-tokens kept with their ids in each worker; the cache then starts anew.
CACHE_ENTRIES = 300_000
#: Pre-tokens of more characters are encoded without being kept.
CACHED_CHARS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where Latin-1 prints it, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, payload: bytes | int) -> bytes:
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The ModelProto: an unknown piece at id 0, then the tokens by rank, so that id = 1 + place in rank order."""
    chars = byte_characters()
    unknown, bpe, identity = 2, 2, b"identity"  # Type.UNKNOWN, ModelType.BPE

    def piece(text: str, score: float, kind: int | None = None) -> bytes:
        body = _field(1, text.encode()) + b"\x15" + struct.pack("<f", score)
        return _field(1, body + (_field(3, kind) if kind else b""))

    out = [piece("<unk>", 0.0, unknown)]
    out += [piece("".join(chars[b] for b in token), -float(rank)) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, bpe) + _field(4, len(out)) + _field(40, 0) + b"".join(
        _field(k, (1 << 64) - 1) for k in (41, 42, 43)  # no begin, end or padding piece
    )
    normaliser = _field(1, identity) + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no prefix, removal or escape of spaces
    return b"".join([*out, _field(2, trainer), _field(3, normaliser)])


class Codec:
    """Encodes and decodes with a serialised model. Ids are ranks of the vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes | None = None) -> None:
        self._split = regex.compile(pattern).findall
        self._sp = sentencepiece.SentencePieceProcessor(model_proto=model or serialise(ranks))
        self._mapped = byte_characters()
        self._back = {c: b for b, c in enumerate(self._mapped)}
        self._ranks = np.array(sorted(ranks.values()), "<u4")
        pieces = [self._sp.id_to_piece(i) for i in range(1, self._sp.get_piece_size())]
        self._bytes = dict(zip(self._ranks.tolist(), (bytes(map(self._back.__getitem__, p)) for p in pieces), strict=True))
        self._known = self._Known(self)

    class _Known(dict):
        def __init__(self, codec: Codec) -> None:
            super().__init__()
            self._codec = codec

        def __missing__(self, token: str) -> bytes:
            ids = self._codec._merge(token)
            if len(token) <= CACHED_CHARS:
                self[token] = ids
            return ids

    def _merge(self, token: str) -> bytes:
        ids = self._sp.encode(token.encode().decode("latin-1").translate(self._mapped))
        return self._ranks[np.array(ids, np.int64) - 1].tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of the text, as little-endian unsigned 32-bit integers."""
        if len(self._known) > CACHE_ENTRIES:
            self._known.clear()
        return b"".join(map(self._known.__getitem__, self._split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds the columns `bpe_ids` (binary, little-endian unsigned 32-bit ids) to all columns of docs.

    vocabulary: path of the rank file, read once on the driver (its size does not depend on the data).
    A null text encodes as an empty one; bytes that are no UTF-8 are encoded as U+FFFD. Rows are independent: ties and
    repeated rows need no rule. Columns of docs named as the added one, in any case, are replaced; all others stay,
    whatever their names. Empty input: no rows."""
    return _mapped(docs, vocabulary, pattern, text, "ids")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256: the text encoded, and its ids decoded again. Otherwise as encode()."""
    return _mapped(docs, vocabulary, pattern, text, "digest")


def decode(encoded: DataFrame, vocabulary: str, pattern: str, ids: str = "bpe_ids") -> DataFrame:
    """Adds `bpe_text`, the decoded text of the ids (null: empty). Otherwise as encode()."""
    return _mapped(encoded, vocabulary, pattern, ids, "text")


_ADDED = {
    "ids": [("bpe_ids", "binary")],
    "text": [("bpe_text", "string")],
    "digest": [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
}


def _mapped(docs: DataFrame, vocabulary: str, pattern: str, column: str, what: str) -> DataFrame:
    spark, added = docs.sparkSession, _ADDED[what]
    ranks = read_ranks(vocabulary)
    shared = spark.sparkContext.broadcast((ranks, serialise(ranks)))
    kept = named(docs.columns, dict(added))
    source = docs.select(boxed(docs, kept).alias("own"), F.col(f"`{column}`").cast("binary").alias("value"))
    fresh = [f"new_{i}" for i in range(len(added))]
    form = StructType([source.schema["own"], *(StructField(n, {"binary": BinaryType(), "string": StringType(), "long": LongType()}[t]) for n, (_, t) in zip(fresh, added, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, model = shared.value
        codec = Codec(ranks, pattern, model)
        for batch in batches:
            values = batch.column("value")
            if what == "text":
                new = [pa.array([codec.decode(x.as_py() or b"").decode("utf-8", "replace") for x in values], pa.string())]
            elif what == "ids":
                new = [pa.array([codec.encode((x.as_py() or b"").decode("utf-8", "replace")) for x in values], pa.binary())]
            else:
                n, first, second = [], [], []
                for x in values:
                    ids = codec.encode((x.as_py() or b"").decode("utf-8", "replace"))
                    n.append(len(ids) // 4)
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                new = [pa.array(n, pa.int64()), pa.array(first), pa.array(second)]
            yield pa.RecordBatch.from_arrays([batch.column("own"), *new], names=["own", *fresh])

    return source.mapInArrow(tidy(run), form).select(*unboxed(kept), *(F.col(n).alias(name) for n, (name, _) in zip(fresh, added, strict=True)))
