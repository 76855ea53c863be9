"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again and again as it grows. Rolling hashes of the turn prefixes identify the
conversations that are a prefix of a longer one; anti-joins keep the maximal ones, which are then rendered.

A prefix hash is a sum over its turns of a hash of place, role and text, so it is built from chunks of turns:
a conversation of any length is spread over many groups, each of the turns of 256 turn numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Turn numbers in one chunk, and so in one rendered part.
CHUNK_TURNS = 256
#: Sums that make up a prefix hash, and bits of their terms, so that millions of turns cannot overflow a long: prefixes
#: are told apart by 160 bits.
SUMS, TERM_BITS = 4, 40
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, chunk, turn, role, text of the turns that take part."""
    rows = conversations.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    ).filter("conv is not null")
    return rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(-(1 << 60))))


def _in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """One row a chunk with its turns (turn, role, text): equal ones once, by number (null first), role and text."""
    return rows.groupBy("conv", "chunk", *keys).agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))


def prefixes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the turns: conv, place (from 1), n (turns of the conversation) and the rolling prefix hashes a0, a1... at every
    turn; and conv, chunk and part, the chunk's number within the conversation.

    Texts are shuffled here to put the turns of a chunk in order; from then on a turn is its hashes. What is joined
    by conversation is a row a chunk. Equal turns of a chunk count once, null turn numbers come first. Empty input: no rows."""
    each = range(SUMS)
    own = lambda k: F.transform("turns", lambda t: F.xxhash64(F.lit(k), t["role"], t["text"]))
    hashes = checkpointed(_in_order(rows).select("conv", "chunk", *(own(k + 1).alias(f"h{k}") for k in each)))
    every = Window.partitionBy("conv")
    before = every.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashes.select("conv", "chunk", F.size("h0").alias("c"))
    starts = sizes.select("conv", "chunk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"), F.sum("c").over(every).alias("n"), (F.row_number().over(every.orderBy("chunk")) - 1).alias("part"))
    starts = checkpointed(starts)
    term = lambda k: F.transform(f"h{k}", lambda h, i: F.xxhash64(F.lit(k + 1), F.col("start") + i, h).bitwiseAND(F.lit((1 << TERM_BITS) - 1)))
    terms = hashes.join(starts, ["conv", "chunk"]).select("conv", "chunk", "start", "n", *(term(k).alias(f"t{k}") for k in each))
    added = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    sums = terms.select("conv", "chunk", *(added(f"t{k}").alias(f"c{k}") for k in each))
    offsets = sums.select("conv", "chunk", *(F.coalesce(F.sum(f"c{k}").over(before), F.lit(0)).alias(f"o{k}") for k in each))
    turns = terms.join(offsets, ["conv", "chunk"]).select("conv", "chunk", "start", "n", *(f"o{k}" for k in each), F.posexplode(F.arrays_zip(*(f"t{k}" for k in each))).alias("i", "t"))
    rolling = Window.partitionBy("conv", "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    out = turns.select("conv", (F.col("start") + F.col("i") + 1).alias("place"), "n", *((F.col(f"o{k}") + F.sum(f"t.t{k}").over(rolling)).alias(f"a{k}") for k in each))
    return checkpointed(out), starts.select("conv", "chunk", "part")


def maximal(found: DataFrame) -> DataFrame:
    """conv, n_turns and n_logged (equal conversations) of those that are no proper prefix of another. Of equal ones the
    smallest id stays. Empty input: no rows."""
    prefix = ["place", *(f"a{k}" for k in range(SUMS))]
    whole = found.filter("place = n").groupBy(*prefix).agg(F.min("conv").alias("conv"), F.count("*").alias("n_logged"))
    inner = found.filter("place < n").select(*prefix).distinct()
    return whole.join(inner, prefix, "left_anti").select("conv", F.col("place").alias("n_turns"), "n_logged")


def formatted(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, part, n_turns, n_logged and text: the maximal conversations, rendered.

    Of equal conversations the smallest id stands for all (n_logged tells how many). A part holds the turns of one
    range of CHUNK_TURNS turn numbers; the parts of a conversation, numbered from 0, joined in order are its
    rendering. Turns come by number (null first), equal numbers by role and text; rows equal in all four columns
    count once; null roles and texts are empty; rows without a conversation id take no part; other columns are ignored,
    whatever their names. All rows of one turn number are one chunk. Empty input: no rows."""
    rows = _turns(conversations, conv_id, turn, role, text)
    found, chunks = prefixes(rows)
    parts = maximal(found).join(chunks, "conv").select("conv", "chunk", "part", "n_turns", "n_logged")  # a row a chunk
    kept = _in_order(rows.join(parts, ["conv", "chunk"]), "part", "n_turns", "n_logged")
    piece = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(f"{CLOSE}\n"))
    return kept.select(F.col("conv").alias("conv_id"), "part", "n_turns", "n_logged", F.array_join(F.transform("turns", piece), "").alias("text"))
