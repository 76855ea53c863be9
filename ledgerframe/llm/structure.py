"""Conversation structure repair: the cheapest edits that make the roles of a conversation `(s?(ua)+)?`.

A dynamic program over the turns that are retained. With the prefix sums of the deletion price taken off, a deleted turn
costs nothing more and a retained one saves its deletion, so the best way to reach a role is a running minimum for each
role that was retained last; the pair of two retained roles says what has to be inserted between them. Of equally cheap
ways the one of least audit (the initials of its edits) counts. No audit that ends in one role is a prefix of one that
ends in another, so their order after a turn follows from their order before it: a way is a price and a rank.

Turns are dealt out by ranges of conversation and turn, so that a long conversation spreads over many tasks. A task
settles the conversations that lie within it. What may go on in another task, or is long, is sent on in blocks: which
texts occurred in earlier blocks is found by grouping their digests, and the blocks of a conversation then pass in order.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import checkpointed, tidy

#: Turns and bytes of text of a block.
BLOCK_TURNS, BLOCK_BYTES = 4_096, 1 << 20
#: Prices of the edits, and what an unfinished turn that stays costs.
DELETE, REROLE, INSERT, UNFINISHED = 3, 2, 2, 1
_WHITE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
#: What was retained last: nothing, or a turn of this role.
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_KINDS = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
#: Turns to insert between two retained roles; a system turn can only be the first.
_BETWEEN = {
    (_NOTHING, _SYSTEM): 0, (_NOTHING, _USER): 0, (_NOTHING, _ASSISTANT): 1, (_SYSTEM, _USER): 0, (_SYSTEM, _ASSISTANT): 1,
    (_USER, _USER): 1, (_USER, _ASSISTANT): 0, (_ASSISTANT, _USER): 0, (_ASSISTANT, _ASSISTANT): 1,
}
_AT_END = {_NOTHING: (), _SYSTEM: ("user", "assistant"), _USER: ("assistant",), _ASSISTANT: ()}
_NAMES = {_USER: "user", _ASSISTANT: "assistant"}
_OPPOSITE = {_SYSTEM: "", _USER: "assistant", _ASSISTANT: "user"}
#: From any state the rest of a conversation costs at most 5 more than from any other (a system turn deleted, a turn
#: inserted), so a state that is dearer than another by more is on no cheapest way.
_SLACK = 5

#: A state's way into a turn: the state before, and the edits as initials.
Move = tuple[int, str]
#: Prices and ranks of the four states; a state that cannot be has the price None.
Ways = tuple[tuple[int | None, ...], tuple[int, ...]]
_BEGIN: Ways = ((0, None, None, None), (0, 0, 0, 0))


def _step(ways: Ways, kind: int | None, unfinished: bool, must_go: bool) -> tuple[Ways, int, tuple[Move | None, ...]]:
    """The ways after one more turn, what their prices were lowered by, and how each state is reached. Prices have the
    deletion of every turn so far taken off."""
    prices, ranks = ways
    best: list[tuple[int, int, str, int] | None] = [(p, ranks[k], "D", k) if p is not None else None for k, p in enumerate(prices)]
    if not must_go:
        for role in (_SYSTEM, _USER, _ASSISTANT):
            if role != kind and role == _SYSTEM:
                continue
            own = (0 if role == kind else REROLE) + (UNFINISHED if unfinished else 0) - DELETE
            for last, price in enumerate(prices):
                n = _BETWEEN.get((last, role))
                if price is not None and n is not None:
                    found = (price + n * INSERT + own, ranks[last], "I" * n + ("K" if role == kind else "R"), last)
                    if best[role] is None or found < best[role]:
                        best[role] = found
    least = min(b[0] for b in best if b)
    best = [b if b and b[0] - least <= _SLACK else None for b in best]
    order = {k: r for r, k in enumerate(sorted((k for k, b in enumerate(best) if b), key=lambda k: best[k][1:3]))}
    now = tuple(b[0] - least if b else None for b in best), tuple(order.get(k, 0) for k in range(4))
    return now, least, tuple((b[3], b[2]) if b else None for b in best)


class _Steps(dict):
    """The steps met so far, each with a number: prices differ by little, so there are few hundreds of them."""

    def __init__(self) -> None:
        super().__init__()
        self.moves: list[tuple[Move | None, ...]] = []

    def __missing__(self, key: tuple) -> tuple[int, Ways, int]:
        ways, lowered, moves = _step(*key)
        self.moves.append(moves)
        self[key] = found = len(self.moves) - 1, ways, lowered
        return found


_STEPS = _Steps()


class Repair:
    """One conversation, turn by turn. Of its turns only two bytes each are kept, for the audit."""

    def __init__(self) -> None:
        self._ways, self._base, self._taken = _BEGIN, 0, array("H")
        self._texts = [hashlib.sha256(), None, None, None]  # of what each way leaves
        self._first = self._last = self._initial = None
        self._turns = self._numbers = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        """The next turn; seen: its role and text occurred before."""
        if turn is not None:
            self._first = turn if self._first is None else self._first
            self._numbers += turn != self._last
            self._last = turn
        if self._turns and self._initial + role[:1] not in _LEGAL:
            self.illegal += 1
        self._initial = role[:1]
        bare = text.rstrip(_WHITE)
        blank, cut = not bare, bare[-1:] not in (".", "!", "?")
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += cut and not seen and not blank
        self._turns += 1
        number, self._ways, lowered = _STEPS[self._ways, _KINDS.get(role[:1]), cut, blank or seen]
        self._base += lowered
        self._taken.append(number)
        self._follow(_STEPS.moves[number], role, text)

    def _follow(self, moves: tuple[Move | None, ...], role: str, text: str) -> None:
        before, used, after = self._texts, set(), [None] * 4
        for state in (k for k in range(4) if moves[k]):
            last, edits = moves[state]
            after[state] = before[last].copy() if last in used or any(m and m[0] == last for m in moves[state + 1 :]) else before[last]
            used.add(last)
            if edits != "D":
                rows = [f"{_OPPOSITE[state]}:"] * (len(edits) - 1)
                rows.append(f"{role if edits[-1] == 'K' else _NAMES[state]}:{text}")
                after[state].update(("\n" * (last != _NOTHING) + "\n".join(rows)).encode())
        self._texts = after

    def end(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit and the digest of what is left."""
        prices, ranks = self._ways
        cost, _, state = min((p + len(_AT_END[k]) * INSERT, ranks[k], k) for k, p in enumerate(prices) if p is not None)
        text = self._texts[state]
        if more := _AT_END[state]:
            text.update("".join(f"\n{r}:" for r in more).encode())
        edits = ["I" * len(more)]
        for number in reversed(self._taken):
            state, own = _STEPS.moves[number][state]
            edits.append(own)
        gaps = 0 if self._first is None else self._last - self._first + 1 - self._numbers
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, DELETE * self._turns + self._base + cost, "".join(reversed(edits)), text.hexdigest()


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_KIND_OF = {"audit": StringType(), "repaired_sha256": StringType()}
_BLOCK = [("block", LongType()), ("turns", ArrayType(LongType())), ("roles", ArrayType(StringType())), ("texts", ArrayType(StringType())), ("keys", ArrayType(BinaryType()))]


class _Out:
    """Rows of one schema, as batches."""

    def __init__(self, schema: pa.Schema) -> None:
        self._schema, self._rows, self._size = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self._rows.append(row)
        self._size += size + 200
        if self._size > BLOCK_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self._rows:
            columns = list(zip(*self._rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self._schema, strict=True)], schema=self._schema)
            self._rows, self._size = [], 0


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def repaired(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Turns come by number (null first); those of one number by role, then by a hash of the text, and rows that are equal in
    all columns are turns of their own. Null roles and texts count as one space; a null id is a conversation too; other
    columns are ignored, whatever their names. A role that begins with none of s, u and a, an empty one too, cannot stay. A turn's first fault counts: blank, duplicate (role and text seen before),
    truncated. gaps are the numbers missing between the first and the last (nulls apart; none: 0). audit has the edits in
    order: Keep, Rerole, Delete, Insert. Texts of any length are taken whole. Empty input: no rows."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = conversations.select(F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat_ws("\x00", "role", "text"))))  # of role and text
    order = ["conv", "turn", "role", "key"]
    kind = rows.schema["conv"].dataType
    report = [StructField(c, _KIND_OF.get(c, LongType())) for c in REPORT]
    form = StructType([StructField("conv", kind), *report, *(StructField(n, t) for n, t in _BLOCK)])
    arrow = _arrow_of(form)
    none, no_block = (None,) * len(REPORT), (None,) * len(_BLOCK)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, number = _Out(arrow), TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # of the conversation that is read
        size, current, whole = 0, (nothing := object()), False  # the first one may have begun in another task

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, number
            if held:
                yield from out.add((held[0][0], *none, number, *(list(c) for c in list(zip(*held, strict=True))[1:])), size)
            held, size, number = [], 0, number + 1

        for row in _rows_of(batches):
            if row[0] != current:
                if held and whole:
                    repair, seen = Repair(), set()
                    for _, t, r, x, k in held:
                        repair.add(t, r, x, k in seen)
                        seen.add(k)
                    yield from out.add((current, *repair.end(), *no_block))
                    held, size = [], 0
                else:
                    yield from sent()
                whole, current = current is not nothing, row[0]
            held.append(row)
            size += len(row[3])
            if size > BLOCK_BYTES or len(held) >= BLOCK_TURNS:
                whole = False
                yield from sent()
        yield from sent()  # the last one may go on in another task
        yield from out.rest()

    dealt = rows.select("conv", "turn", "role", "text", "key").repartitionByRange(*order).sortWithinPartitions(*order)
    first = checkpointed(dealt.mapInArrow(tidy(settle), form))
    done = first.filter("block is null").select("conv", *REPORT)
    blocks = first.filter("block is not null").select("conv", *(n for n, _ in _BLOCK))
    return done.unionByName(_passed(blocks, kind, report)).select(F.col("conv").alias("conv_id"), *REPORT)


def _passed(blocks: DataFrame, kind, report: list[StructField]) -> DataFrame:
    """The reports of conversations in blocks: block numbers follow the order of their turns."""
    keys = blocks.select("conv", "block", F.explode(F.array_distinct("keys")).alias("key"))
    first = keys.groupBy(F.col("conv").alias("c"), F.col("key").alias("k")).agg(F.min("block").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = keys.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")) & (F.col("block") > F.col("first")))
    seen = again.groupBy(F.col("block").alias("b")).agg(F.collect_list("key").alias("seen"))  # a block's turns at most
    rows = blocks.join(seen, F.col("block") == F.col("b"), "left").select("conv", "block", "turns", "roles", "texts", "keys", F.coalesce("seen", F.array().cast("array<binary>")).alias("seen"))
    known = F.transform("keys", lambda k: F.array_contains("seen", k)).alias("known")
    dealt = rows.select("conv", "block", F.arrays_zip("turns", "roles", "texts", "keys", known).alias("t")).repartition("conv").sortWithinPartitions("conv", "block")
    turns = dealt.select("conv", "block", F.explode("t").alias("t")).select("conv", "block", "t.turns", "t.roles", "t.texts", "t.keys", "t.known")  # a turn a row again: batches are counted in rows
    form = StructType([StructField("conv", kind), *report])
    arrow = _arrow_of(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, repair, current, at, own = _Out(arrow), None, None, None, set()
        for conv, block, t, r, x, k, before in _rows_of(batches):
            if repair is None or conv != current:
                if repair is not None:
                    yield from out.add((current, *repair.end()))
                repair, current = Repair(), conv
            if block != at:
                at, own = block, set()
            repair.add(t, r, x, before or k in own)
            own.add(k)
        if repair is not None:
            yield from out.add((current, *repair.end()))
        yield from out.rest()

    return turns.mapInArrow(tidy(run), form)


def _arrow_of(form: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(form)


def applied(conversations: DataFrame, report: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 0), role and text: the repaired conversations, from the same turns and their report (with
    conv_id and audit). An inserted turn has an empty text. Conversations of which nothing is left have no rows.

    Turns and edits are numbered within a conversation and joined by number; a numbering passes through one task, which
    keeps none of it in memory."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = conversations.select(F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat_ws("\x00", "role", "text"))))
    rows = rows.select("conv", "role", "text", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "key")).alias("n"))
    edits = report.select(F.col("conv_id").alias("c"), F.posexplode(F.split("audit", "")).alias("at", "edit")).filter("edit <> ''")
    inserted, gone = F.col("edit") == "I", F.col("edit") == "D"
    along = Window.partitionBy("c").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    edits = edits.select("c", "at", "edit", F.when(~inserted, F.sum(F.when(inserted, 0).otherwise(1)).over(along)).alias("m"), F.sum(F.when(gone, 0).otherwise(1)).over(along).alias("place")).filter(~gone)
    both = edits.join(rows, F.col("c").eqNullSafe(F.col("conv")) & (F.col("m") == F.col("n")), "left")
    system = F.max(F.when(F.col("place") == 1, ((F.col("edit") == "K") & F.startswith("role", F.lit("s"))).cast("int"))).over(along)
    due = F.when((F.col("place") + system) % 2 == 1, "user").otherwise("assistant")
    named: Column = F.when(F.col("edit") == "K", F.col("role")).otherwise(due)
    return both.select(F.col("c").alias("conv_id"), (F.col("place") - 1).alias("place"), named.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
