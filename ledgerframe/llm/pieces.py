"""SentencePiece BPE by vectorised merge rounds over flat arrays.

A text, with blanks as U+2581, falls into words at places that no piece of the vocabulary spans, so words merge on
their own. Words that a worker has not met yet are laid out as one flat array of symbols. Each round looks up the rank
of every adjacent pair, takes the least rank of each word (a segmented minimum), merges its places from the left,
all at once, and closes the gaps; words in which no pair is left drop out.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import boxed, named, tidy, unboxed

#: Words kept with their ids in each worker (the cache then starts anew), and characters of a word that is kept.
CACHE_ENTRIES, CACHED_CHARS = 500_000, 64
#: Characters of text whose words are looked up together.
CHUNK_CHARS = 1 << 20
#: Rounds after which what is left of very long words is merged one pair at a time, from a queue: a round costs as much
#: as the word is long, and a word of n symbols can take n rounds.
ROUNDS = 64
BLANK = "▁"
_RUNS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+").findall
_NONE = np.iinfo(np.int32).max
#: Fixed values of the model format: kinds of pieces, and the kind of model.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE, _BPE = 1, 2, 3, 6, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


def read_model(path: str) -> list[tuple[str, float, int]]:
    """Text, score and kind of the pieces of a model file, by id. Only BPE models with bytes for unknown characters,
    blanks as U+2581 before words and no other normalisation are known: others raise ValueError."""
    with open(path, "rb") as file:
        data = file.read()
    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, _NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    plain = not normaliser.get(2) and normaliser.get(3, 1) and not normaliser.get(4, 1) and normaliser.get(5, 1)
    if trainer.get(3) != _BPE or not trainer.get(35) or trainer.get(24) or not plain or {k for _, _, k in pieces} - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
        raise ValueError("the model is no BPE model with byte fallback and without normalisation")
    return pieces


class _Table:
    """A set of numbers (0 or more) in open addressing: most lookups of an array take one step."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(8, int(len(keys) * 8).bit_length())
        self._shift = np.uint64(64 - bits)
        self.keys = np.full((1 << bits) + len(keys) + 1, -1)
        for key, at in zip(keys.tolist(), self._home(keys).tolist(), strict=True):
            while self.keys[at] >= 0:
                at += 1
            self.keys[at] = key

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in `keys`: that of a free one (-1) if it is not in the set."""
        at = self._home(keys)
        rest = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(rest):
            at[rest] += 1
            found = self.keys[at[rest]]
            rest = rest[(found != keys[rest]) & (found >= 0)]
        return at

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.keys[self.places(keys)] >= 0


class Codec:
    """Encodes and decodes by the pieces of a model."""

    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self._chars = len(pieces)  # a character that is no piece is the symbol of this number plus its code point
        self._width = self._chars + 0x110000
        known = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == _NORMAL}
        self._single = {p: i for p, i in known.items() if len(p) == 1}
        self._byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        order = {s: r for r, s in enumerate(sorted({s for _, s, kind in pieces if kind == _NORMAL}, reverse=True))}
        symbol = lambda p: known.get(p) if p in known else self._chars + ord(p) if len(p) == 1 else None
        splits = [(symbol(p[:k]), symbol(p[k:]), i, order[pieces[i][1]]) for p, i in known.items() for k in range(1, len(p))]
        table = np.array(sorted((a * self._width + b, i, r) for a, b, i, r in splits if a is not None and b is not None), np.int64).reshape(-1, 3)
        self._table = _Table(table[:, 0])
        own = self._table.places(table[:, 0])
        self._ranks, self._made = np.full(len(self._table.keys), _NONE, np.int32), np.zeros(len(self._table.keys), np.int32)
        self._ranks[own], self._made[own] = table[:, 2], table[:, 1]
        self._pairs = {k: (r, i) for k, i, r in table.tolist()}
        self._symbols = np.arange(self._chars, self._width, dtype=np.int32)
        self._symbols[[ord(c) for c in self._single]] = list(self._single.values())
        soonest = np.full(self._chars, _NONE)  # least rank of the pairs that a piece is part of
        for k, r in zip(table[:, 0].tolist(), table[:, 2].tolist(), strict=True):
            for part in divmod(k, self._width):
                if part < self._chars:
                    soonest[part] = min(soonest[part], r)
        self._sooner = np.zeros(self._chars, bool)
        self._sooner[table[:, 1]] = soonest[table[:, 1]] <= table[:, 2]
        near = {p[k : k + 2] for p in known for k in range(len(p) - 1)}
        self._near = _Table(np.array([ord(a) << 21 | ord(b) for a, b in near], np.int64))
        self._spans = any(a != BLANK and b == BLANK for a, b in near)
        self._raw = {str(i) for i in self._byte.values()}
        self._surface = {str(i): bytes((int(p[3:5], 16),)) if kind == _BYTE else {_CONTROL: "", _UNKNOWN: " ⁇ "}.get(kind, p.replace(BLANK, " ")).encode() for i, (p, _, kind) in enumerate(pieces)}
        self._opens = {str(i) for p, i in known.items() if p.startswith(BLANK)}
        self._control = {str(i) for i, (_, _, kind) in enumerate(pieces) if kind == _CONTROL}
        self._known: dict[str, str] = {}
        self._spelled = self._Spelled(self)

    class _Spelled(dict):
        """Ids of a symbol as text: its own, or those of the bytes of a character that is no piece."""

        def __init__(self, codec: Codec) -> None:
            super().__init__((i, str(i)) for i in range(codec._chars))
            self._codec = codec

        def __missing__(self, symbol: int) -> str:
            character = chr(symbol - self._codec._chars).encode()
            return ",".join(str(self._codec._byte[b]) for b in character)

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols, and the piece that it makes."""
        at = self._table.places(a.astype(np.int64) * self._width + b)
        return self._ranks[at], self._made[at]

    def merged(self, words: list[str]) -> list[list[int]]:
        """The symbols that are left of each word."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.array([len(w) for w in words])
        cut = np.append(True, ~self._near.has(code[:-1] << 21 | code[1:]))  # a word falls apart between characters that are neighbours in no piece
        cut[np.cumsum(sizes) - sizes] = True
        sym, word = self._symbols[code], np.cumsum(cut, dtype=np.int32) - 1
        last = word[np.cumsum(sizes) - 1]  # the last part of each word
        rank, made = self._look_up(sym, np.append(sym[1:], 0))
        rank[np.append(cut[1:], True)] = _NONE  # of the pair that begins at each symbol
        done_sym, done_word = [], []
        for _ in range(ROUNDS):
            if not len(sym):
                break
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            stay = least < _NONE
            if not stay.all():  # words without a pair are done
                done_sym.append(sym[~stay])
                done_word.append(word[~stay])
            at = self._chosen(sym, word, rank, made, least)
            stay[at + 1] = False
            sym[at] = made[at]
            self._renew(sym, word, rank, made, at)
            sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
        for w in np.unique(word).tolist():
            left = np.array(self._queued(sym[word == w].tolist()), np.int32)
            done_sym.append(left)
            done_word.append(np.full(len(left), w, np.int32))
        sym, word = np.concatenate([np.empty(0, np.int32), *done_sym]), np.concatenate([np.empty(0, np.int32), *done_word])
        order = np.argsort(word, kind="stable")
        ends = np.searchsorted(word[order], last, "right").tolist()
        sym = sym[order].tolist()
        return [sym[s:e] for s, e in zip([0, *ends], ends, strict=False)]

    def _renew(self, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray, at: np.ndarray) -> None:
        """The pairs on both sides of the symbols just made at `at`; the symbol after each of these goes."""
        after = np.minimum(at + 2, len(sym) - 1)
        inside = (at + 2 < len(sym)) & (word[after] == word[at])
        rank[at] = _NONE
        rank[at[inside]], made[at[inside]] = self._look_up(sym[at[inside]], sym[after[inside]])
        before = np.where(np.append(False, at[1:] == at[:-1] + 2), at - 2, at - 1)
        inside = (before >= 0) & (word[before] == word[at])
        rank[before[inside]], made[before[inside]] = self._look_up(sym[before[inside]], sym[at[inside]])

    def _chosen(self, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Places of the pairs that a round merges: those of least rank in their word, from the left without overlap,
        up to the first of a word that brings forth a pair of the same or a lesser rank, which would come before the rest."""
        at = np.flatnonzero((rank == least) & (least < _NONE))
        if not len(at):
            return at
        fresh = np.append(True, at[1:] != at[:-1] + 1)
        at = at[(np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 0]
        new, own = made[at], word[at]
        may = self._sooner[new]
        if not may.any():
            return at
        before = np.where(np.append(False, at[1:] == at[:-1] + 2), np.roll(new, 1), sym[at - 1])  # it may just have been made
        after = np.minimum(at + 2, len(sym) - 1)
        left = np.where((at > 0) & (word[at - 1] == own), self._look_up(before, new)[0], _NONE)
        right = np.where((at + 2 < len(sym)) & (word[after] == own), self._look_up(new, sym[after])[0], _NONE)
        sooner = np.minimum(left, right) <= least[at]
        count = np.cumsum(sooner) - sooner
        first = np.append(True, own[1:] != own[:-1])
        return at[count == count[first][np.cumsum(first) - 1]]

    def _queued(self, sym: list[int]) -> list[int]:
        """One merge at a time: least rank first, then from the left."""
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (found := self._pairs.get(sym[i] * self._width + sym[j])):
                heapq.heappush(queue, (found[0], i, j, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, a, b, new = heapq.heappop(queue)
            if sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i], sym[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in sym if s >= 0]

    def _words(self, text: str) -> list[str]:
        """The words of a text, each without the one blank before it."""
        if self._spans:
            return [text.replace(" ", BLANK)]
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [w[1:] for w in _RUNS(f" {text}".replace(" ", BLANK))]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, as decimal numbers with commas between them."""
        known, spelled, out, held, size = self._known, self._spelled.__getitem__, [], [], 0

        def flush() -> None:
            fresh = list(set().union(*held).difference(known))
            for w, symbols in zip(fresh, self.merged([BLANK + w for w in fresh]) if fresh else [], strict=True):
                known[w] = ",".join(map(spelled, symbols))
            out.extend(",".join(map(known.__getitem__, words)) for words in held)
            held.clear()
            if len(known) > CACHE_ENTRIES:
                known.clear()
            for w in fresh:
                if len(w) > CACHED_CHARS:
                    known.pop(w, None)

        for text in texts:
            held.append(self._words(text) if text else [])
            size += len(text)
            if size >= CHUNK_CHARS:
                flush()
                size = 0
        flush()
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The text of the ids, in UTF-8: the first blank of the first piece goes, runs of bytes that are no UTF-8 become
        one U+FFFD a byte."""
        return self.decoded(list(map(str, ids)))

    def decoded(self, ids: list[str]) -> bytes:
        """decode() for ids as decimal numbers."""
        whole = b"".join(map(self._surface.__getitem__, ids))
        try:
            whole.decode()
        except UnicodeDecodeError:
            whole = b"".join(self._mended(ids))
        return whole[1:] if next((i for i in ids if i not in self._control), None) in self._opens else whole

    def _mended(self, ids: list[str]) -> Iterator[bytes]:
        run = bytearray()
        for i in [*ids, None]:
            if i in self._raw:
                run += self._surface[i]
                continue
            while run:
                try:
                    run.decode()
                    size, good = len(run), bytes(run)
                except UnicodeDecodeError as bad:
                    size, good = (bad.start, bytes(run[: bad.start])) if bad.start else (1, "�".encode())
                yield good
                del run[:size]
            if i is not None:
                yield self._surface[i]


#: Codecs of the models that a worker has met, with their caches: workers outlive tasks.
_CODECS: dict[tuple, Codec] = {}


def _codec(pieces: list[tuple[str, float, int]]) -> Codec:
    key = tuple(pieces)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(pieces)
    return _CODECS[key]


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Adds `piece_ids` (array of int) to all columns of docs: the ids that the library gives without begin and end.

    model: path of the model file, read once on the driver (its size does not depend on the data). A null text encodes as
    an empty one, an empty one has no ids; bytes that are no UTF-8 are encoded as U+FFFD. Rows are independent: ties and
    repeated rows need no rule. Columns of docs named as the added one, in any case, are replaced; all others stay,
    whatever their names. Empty input: no rows."""
    return _mapped(docs, model, text, "ids")


def decode(encoded: DataFrame, model: str, ids: str = "piece_ids") -> DataFrame:
    """Adds `piece_text`, the decoded text of the ids (null: empty). Otherwise as encode()."""
    return _mapped(encoded, model, ids, "text")


def round_trip(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256: the text encoded, and its ids decoded again. Otherwise as encode()."""
    return _mapped(docs, model, text, "digest")


_ADDED = {
    "ids": [("piece_ids", ArrayType(IntegerType()))],
    "text": [("piece_text", StringType())],
    "digest": [("n_tokens", LongType()), ("ids_sha256", StringType()), ("decoded_sha256", StringType())],
}


def _numbers(ids: str) -> list[int]:
    return list(map(int, ids.split(","))) if ids else []


def _mapped(docs: DataFrame, model: str, column: str, what: str) -> DataFrame:
    added = _ADDED[what]
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))
    kept = named(docs.columns, dict(added))
    value = F.col(f"`{column}`") if what == "text" else F.col(f"`{column}`").cast("binary")
    source = docs.select(boxed(docs, kept).alias("own"), value.alias("value"))
    fresh = [f"new_{i}" for i in range(len(added))]
    form = StructType([source.schema["own"], *(StructField(n, kind) for n, (_, kind) in zip(fresh, added, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            values = batch.column("value")
            if what == "text":
                new = [pa.array([codec.decode(x.as_py() or []).decode() for x in values], pa.string())]
            else:
                ids = codec.encode([(x.as_py() or b"").decode("utf-8", "replace") for x in values])
                if what == "ids":
                    new = [pa.array([_numbers(x) for x in ids], pa.list_(pa.int32()))]
                else:
                    digests = [hashlib.sha256(x.encode()).hexdigest() for x in ids]
                    texts = [hashlib.sha256(codec.decoded(x.split(",") if x else [])).hexdigest() for x in ids]
                    new = [pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("own"), *new], names=["own", *fresh])

    return source.mapInArrow(tidy(run), form).select(*unboxed(kept), *(F.col(n).alias(name) for n, (name, _) in zip(fresh, added, strict=True)))
