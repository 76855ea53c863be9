"""Connected components by alternating large-star and small-star steps on DataFrames.

Links never reach the driver: each round is two aggregations and two joins on the links themselves, and
the only thing fetched is one row of sums that tells whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Rounds double what a node has seen, so this many suffice for any number of nodes that fits a long.
MOST_ROUNDS = 64
#: Nodes with more than this part of all links are broadcast: they are fewer than twice as many.
HOT = 1_000


def _with_least(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """links with the column m of their node a. A node that a third of the links share does not send them to one task."""
    hot = F.broadcast(least.filter(F.col("c") > max(HOT, total // HOT)).select("a", F.col("m").alias("hot")))
    marked = links.join(hot, "a", "left")
    rest = marked.filter("hot is null").drop("hot").join(least.select("a", "m"), "a")
    return marked.filter("hot is not null").select("a", "b", F.col("hot").alias("m")).unionByName(rest)


def _star(links: DataFrame, both_ways: bool, total: int) -> DataFrame:
    """links (a > b). Large star: larger neighbours go to the smallest; small star: smaller ones and the node itself."""
    sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else links
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("c"))
    if both_ways:
        moved = _with_least(sides, least, total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = _with_least(links, least, total).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def roots(links: DataFrame) -> DataFrame:
    """links: two long columns a and b, in any order, with repeats or loops. Returns node, root for every node
    that is not the smallest of its component; root is that smallest node. Null ends are left out."""
    now = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), F.sum((F.xxhash64("a", "b") % (1 << 40)).cast("long"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, now = state, checkpointed(_star(_star(now, True, state[0]), False, state[0]))
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
