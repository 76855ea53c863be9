"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; leaves that hold more than LEAF_VECTORS of the table's vectors are split
again, each by a subtree fitted in the cluster on a bounded sample of its own, so leaves stay small as the table
grows. A query walks the tree through a priority queue of subtrees, nearest centre first, and only the centres
below opened nodes are looked at. How many leaves it visits is calibrated: for some of the queries the true
neighbours are found by brute force, and visits are widened until the wanted share of these lies in visited leaves.

Equal vectors are one entry with its smallest ids, which is all that a result can need of them. Leaves are
cut into blocks of bounded size, as are the queries that visit a leaf, so no task depends on how many
vectors or queries meet in one place.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import checkpointed, tidy

#: Vectors that fit the tree (and each subtree), and queries that calibrate the visits: those of least hash.
SAMPLE, CALIBRATION = 20_000, 200
BRANCHES, LEAF_SAMPLE, ROUNDS = 64, 40, 8
#: Vectors that a leaf may hold before it is split, and leaves at most: together they bound the tree, which is
#: broadcast (200,000 centres of 64 numbers are 100 MB). Beyond them leaves grow, and are cut into more blocks.
LEAF_VECTORS, MOST_LEAVES = 4_096, 200_000
#: Share of the calibration queries' true neighbours that must lie in the visited leaves.
RECALL, WIDEN = 0.94, 1.05
BLOCK_VECTORS, BLOCK_QUERIES = 4_096, 1_024
#: A vector asked for by so many queries has its answers joined in several parts.
HOT_QUESTION = 10_000


@dataclass
class Tree:
    """centres[i] holds the unit centres of the children of node i, whose numbers children[i] lists; a node without
    children is leaf number leaf[i]."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def add(self) -> int:
        self.centres.append(np.empty((0, 0)))
        self.children.append([])
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def end(self, node: int) -> None:
        self.leaf[node] = self.leaves
        self.leaves += 1

    def put(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: down the nearest centres."""
        out = np.empty(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not self.children[node]:
                out[at] = self.leaf[node]
                continue
            near = np.argmax(x[at] @ self.centres[node].T, axis=1)
            todo += [(c, at[near == k]) for k, c in enumerate(self.children[node]) if (near == k).any()]
        return out

    def order(self, q: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves by best bin first: of all unopened nodes the one with the nearest centre is opened
        next, and its children join the queue."""
        queue, out = [(-1.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf[node])
                continue
            for near, c in zip((self.centres[node] @ q).tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (-near, c))
        return out

    def graft(self, leaf: int, sub: Tree) -> None:
        """Put a subtree in the place of a leaf; its first leaf takes that leaf's number, the others new ones."""
        node, shift = self.leaf.index(leaf), len(self.leaf)
        number = {0: node} | {k: shift + k - 1 for k in range(1, len(sub.leaf))}
        again = [leaf, *range(self.leaves, self.leaves + sub.leaves - 1)]
        for k in range(len(sub.leaf)):
            if k:
                self.add()
            self.centres[number[k]] = sub.centres[k]
            self.children[number[k]] = [number[c] for c in sub.children[k]]
            self.leaf[number[k]] = again[sub.leaf[k]] if sub.leaf[k] >= 0 else -1
        self.leaves += sub.leaves - 1


def grow(x: np.ndarray) -> Tree:
    """Hierarchical spherical k-means over unit vectors; the same for the same sample."""
    tree = Tree()
    unit = lambda v: v / max(1e-12, float(np.linalg.norm(v)))
    todo = [(tree.add(), np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        own = x[at]
        k = min(BRANCHES, len(at) // (LEAF_SAMPLE // 2))
        if len(at) > LEAF_SAMPLE and k > 1:
            centre = own[np.linspace(0, len(at) - 1, k).astype(int)]
            for _ in range(ROUNDS):
                near = np.argmax(own @ centre.T, axis=1)
                centre = np.array([unit(own[near == j].mean(axis=0)) if (near == j).any() else centre[j] for j in range(k)])
            near = np.argmax(own @ centre.T, axis=1)
            parts = [(j, at[near == j]) for j in range(k) if (near == j).any()]
            if len(parts) > 1:
                tree.centres[node] = np.array([centre[j] for j, _ in parts])
                for _, part in parts:
                    child = tree.add()
                    tree.children[node].append(child)
                    todo.append((child, part))
                continue
        tree.end(node)
    return tree


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(q: np.ndarray, x: np.ndarray, first: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k nearest rows of x: by a matrix product, then by cosine summed up the same way everywhere."""
    qn, xn = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    rough = (q @ x.T) / qn[:, None] / xn[None, :]
    most = min(len(x), 2 * k)
    part = np.argpartition(-rough, most - 1, axis=1)[:, :most] if most < len(x) else np.tile(np.arange(len(x)), (len(q), 1))
    for i in range(len(q)):
        at = part[i]
        edge = rough[i, at].min()
        if most < len(x):  # all that tie with the last, within rounding
            at = np.flatnonzero(rough[i] >= edge - 1e-12)
        exact = (x[at] * q[i]).sum(axis=1) / (qn[i] * xn[at])
        order = np.lexsort((first[at], -exact))[:k]
        yield i, at[order], exact[order]


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """id, e: vectors of the commonest length that are finite and not zero."""
    e = F.col("e")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("e")).filter("id is not null and e is not null")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & (F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) > 0)
    rows = rows.filter(fine)
    common = rows.groupBy(F.size("e").alias("w")).count().sort(F.desc("count"), "w").first()
    width = common["w"] if common else 0
    return rows.filter(F.size("e") == width), width


def _entries(vectors: DataFrame, k: int, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame, int]:
    """Distinct vectors (k1, k2, e, ids: their k + 1 smallest ids), all rows (k1, k2, id), and the vectors' length."""
    rows, width = _usable(vectors, vec_id, embedding)
    rows = rows.withColumn("k1", F.xxhash64("e")).withColumn("k2", F.hash("e"))
    key = Window.partitionBy("k1", "k2").orderBy("id")  # limited within each task before the shuffle
    entries = rows.select("k1", "k2", "id", "e").withColumn("r", F.row_number().over(key)).filter(F.col("r") <= k + 1)
    entries = entries.groupBy("k1", "k2").agg(F.first("e").alias("e"), F.sort_array(F.collect_list("id")).alias("ids"))
    return checkpointed(entries), rows.select("k1", "k2", "id"), width


def _sampled(entries: DataFrame) -> list[tuple]:
    some = entries.select("k1", "k2", "e").sort(F.hash("k1"), "k1", "k2").limit(SAMPLE)
    return sorted((r.k1, r.k2, tuple(r.e)) for r in some.toLocalIterator())


def _placed(entries: DataFrame, tree: Tree, width: int) -> DataFrame:
    """entries with their leaf."""
    shared = entries.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.put(_units(_matrix(batch.column("e"), width))) if batch.num_rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=[*batch.schema.names, "leaf"])

    return entries.mapInArrow(tidy(place), StructType([*entries.schema, StructField("leaf", IntegerType())]))


def fitted(entries: DataFrame, width: int) -> tuple[Tree, dict[int, int]]:
    """The tree, and how many distinct vectors each leaf holds."""
    taken = _sampled(entries)
    tree = grow(_units(np.array([r[2] for r in taken], np.float64)) if taken else np.zeros((0, 0)))
    while True:
        placed = _placed(entries, tree, width)
        sizes = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).toLocalIterator()}  # a row a leaf
        large = {leaf: n for leaf, n in sizes.items() if n > LEAF_VECTORS}
        if not large or tree.leaves >= MOST_LEAVES:
            return tree, sizes
        share = placed.sparkSession.createDataFrame([(leaf, float(1.2 * SAMPLE / n)) for leaf, n in large.items()], "leaf int, share double")
        some = placed.join(F.broadcast(share), "leaf").filter(F.pmod(F.xxhash64("k2", "k1"), F.lit(1 << 20)) < F.col("share") * (1 << 20))

        def split(table: pa.Table) -> pa.Table:
            order = np.lexsort((table["k2"].to_numpy(), table["k1"].to_numpy()))[:SAMPLE]
            return pa.table({"leaf": table["leaf"][:1], "tree": pa.array([pickle.dumps(grow(_units(_matrix(table["e"].combine_chunks(), width))[order]))], pa.binary())})

        before = tree.leaves
        for r in sorted(some.groupBy("leaf").applyInArrow(split, "leaf int, tree binary").toLocalIterator(), key=lambda r: r.leaf):  # bounded by MOST_LEAVES
            if tree.leaves < MOST_LEAVES:
                tree.graft(r.leaf, pickle.loads(bytes(r.tree)))
        if tree.leaves == before:
            return tree, sizes


def search(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", report: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest found of each query, by cosine in double precision.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but the query's own. Ties go to
    the smaller id. Vectors that are null, zero, hold null or non-finite components, or are of another length than
    most, take no part, nor do null ids. Rows repeating an id count once each vector. Other columns are ignored,
    whatever their names. Empty input: no rows. A report, if given, receives `leaves`, `visits` (of a query) and
    `scored` (the share of distinct vectors in the leaves that the mean query visits)."""
    spark = vectors.sparkSession
    entries, rows, width = _entries(vectors, k, vec_id, embedding)
    asked = rows.filter(F.col("id") % every == 0).select("k1", "k2", F.col("id").alias("query_id")).distinct()
    grown, sizes = fitted(entries, width)
    tree = spark.sparkContext.broadcast(grown)
    placed = checkpointed(_placed(entries, grown, width))
    counts = asked.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    questions = counts.select("k1", "k2").join(entries.select("k1", "k2", "e"), ["k1", "k2"])
    visits = _calibrated(placed, questions, tree, k, width)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(_matrix(batch.column("e"), width)) if batch.num_rows else []
            order = [tree.value.order(q, visits) for q in units]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order, pa.list_(pa.int32()))], names=[*batch.schema.names, "leaves"])

    walks = checkpointed(questions.select("k1", "k2", "e").mapInArrow(tidy(walk), StructType([*questions.select("k1", "k2", "e").schema, StructField("leaves", ArrayType(IntegerType()))])))
    asks = {r.leaf: r.n for r in walks.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).toLocalIterator()}
    if report is not None:
        total, n = max(1, sum(sizes.values())), max(1, walks.count())
        report |= {"leaves": grown.leaves, "visits": visits, "scored": sum(asks.get(leaf, 0) * m for leaf, m in sizes.items()) / n / total}
    plan = spark.createDataFrame([(leaf, -(-n // BLOCK_VECTORS), -(-asks.get(leaf, 0) // BLOCK_QUERIES)) for leaf, n in sizes.items()], "leaf int, blocks int, parts int").filter("parts > 0")
    plan = F.broadcast(plan)  # a row a leaf
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.hash("k1", "k2"), F.col(n)).cast("int")
    left = placed.join(plan, "leaf").select("leaf", dealt("blocks").alias("block"), upto("parts").alias("part"), "k1", "k2", "e", "ids")
    right = walks.select("k1", "k2", "e", F.explode("leaves").alias("leaf")).join(plan, "leaf").select("leaf", upto("blocks").alias("block"), dealt("parts").alias("part"), "k1", "k2", "e")

    def meet(have: pa.Table, want: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("k1", "k2", "score", "first", "ids")}
        if have.num_rows and want.num_rows:
            ids = have["ids"].to_pylist()
            first = np.array([i[0] for i in ids])
            q, x = (_matrix(t["e"].combine_chunks(), width) for t in (want, have))
            k1, k2 = want["k1"].to_pylist(), want["k2"].to_pylist()
            for i, at, score in _nearest(q, x, first, k + 1):
                out["k1"] += [k1[i]] * len(at)
                out["k2"] += [k2[i]] * len(at)
                out["score"] += score.tolist()
                out["first"] += first[at].tolist()
                out["ids"] += [ids[j] for j in at]
        return pa.table(out, schema=pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("score", pa.float64()), ("first", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    cell = ("leaf", "block", "part")
    met = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(meet, "k1 long, k2 int, score double, first long, ids array<long>")
    best = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "first")
    met = met.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r", "first")
    # One vector may be that of a third of all queries: its answers, k + 1 rows, go to several parts of these. Fewer than
    # a thousand vectors can be asked for by a thousandth of all queries, so the list of them may be broadcast.
    hot = counts.filter(F.col("n") > max(HOT_QUESTION, (counts.agg(F.sum("n")).first()[0] or 0) // 1_000))
    hot = F.broadcast(hot.select("k1", "k2", F.ceil(F.col("n") / HOT_QUESTION).cast("int").alias("parts")))
    whole = F.coalesce("parts", F.lit(1))
    asked = asked.join(hot, ["k1", "k2"], "left").select("k1", "k2", "query_id", F.pmod(F.hash("query_id"), whole).alias("part"))
    met = met.join(hot, ["k1", "k2"], "left").select("k1", "k2", "score", "ids", F.explode(F.sequence(F.lit(0), whole - 1)).alias("part"))
    found = asked.join(met, ["k1", "k2", "part"]).select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrated(placed: DataFrame, questions: DataFrame, tree, k: int, width: int) -> int:
    """Leaf visits that reach RECALL over the calibration queries, whose neighbours come from brute force."""
    some = questions.sort(F.hash("k2", "k1"), "k1", "k2").limit(CALIBRATION)
    taken = sorted((r.k1, r.k2, tuple(r.e)) for r in some.toLocalIterator())
    if not taken:
        return 1
    q = np.array([r[2] for r in taken])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, score, leaf = [], [], []
            if batch.num_rows:
                first = np.array([i[0] for i in batch.column("ids").to_pylist()])
                leaves = batch.column("leaf").to_numpy()
                for i, near, exact in _nearest(q, _matrix(batch.column("e"), width), first, k + 1):
                    at += [i] * len(near)
                    score += exact.tolist()
                    leaf += leaves[near].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(score, pa.float64()), pa.array(leaf, pa.int32())], names=["q", "score", "leaf"])

    best = Window.partitionBy("q").orderBy(F.desc("score"), "leaf")
    near = placed.mapInArrow(scan, "q int, score double, leaf int").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    true: list[list[int]] = [[] for _ in taken]
    for r in near.toLocalIterator():  # CALIBRATION * (k + 1) rows
        if r.r > 1:  # the first is the query itself
            true[r.q].append(r.leaf)
    places = []
    for unit, leaves in zip(_units(q), true, strict=True):
        order = {leaf: i for i, leaf in enumerate(tree.value.order(unit, tree.value.leaves))}
        places += [order[leaf] for leaf in leaves]
    visits = 1
    while visits < tree.value.leaves and np.mean(np.array(places or [0]) < visits) < RECALL:
        visits = max(visits + 1, int(visits * WIDEN))
    return min(visits, tree.value.leaves)
