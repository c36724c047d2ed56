"""Approximate nearest neighbours: low-dimensional Gaussian (2-stable) projections in a kd-tree.

Vectors are projected to M dimensions. For a vector at distance r of the query, the squared projected distance is r^2
times a chi-square variable of M degrees. So candidates are verified in the order of their projected distance until
the chi-square test says that an unseen vector nearer than the K-th best found would already have come up with
probability STOP. The kd-tree over the projections (built from a bounded sample, holding every row) gives that order
over leaves; a leaf is one group of a shuffle, or several where it is large or many queries search it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import cut, in_arrow, maybe_broadcast, pieces

M = 8  # projected dimensions; even, so that the chi-square distribution is a finite sum
STOP = 0.99
SAMPLE = 20_000  # projected vectors that place the tree's splits
LEAF = 1024  # vectors a leaf is meant to hold
LEAVES = 4096  # of the tree at most; leaves beyond PART vectors are searched in parts
PART = 8192  # vectors of a leaf in one group
BLOCK = 4096  # queries that search a leaf in one group; only a leaf that more come to is read again
CHUNK = 64  # vectors verified between two tests
SEED = 8


def chi_square(x: np.ndarray | float, m: int = M) -> np.ndarray | float:
    """P(chi-square of m degrees <= x), m even."""
    h = np.asarray(x, float) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, m // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


def stop_ratio(p: float = STOP, m: int = M) -> float:
    """The ratio of squared projected distance to squared distance at which the test holds."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def directions(width: int, m: int = M, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, m))


class Tree:
    """Splits of a kd-tree; leaves are numbered from the left."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # dimension, value, children: a leaf i is -1 - i
        self.leaves = 0
        self.root = self._grow(sample, leaves)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        spread = x.max(0) - x.min(0) if len(x) else np.zeros(1)
        if leaves <= 1 or len(x) < 2 or not spread.max() > 0:
            self.leaves += 1
            return -self.leaves
        dim = int(spread.argmax())
        value = float(np.median(x[:, dim]))
        left = x[:, dim] <= value
        if left.all():
            value = float(np.nextafter(x[:, dim].max(), -np.inf))
            left = x[:, dim] <= value
        here = len(self.nodes)
        self.nodes.append((dim, value, 0, 0))
        a = self._grow(x[left], leaves // 2)
        b = self._grow(x[~left], leaves - leaves // 2)
        self.nodes[here] = (dim, value, a, b)
        return here

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = -1 - at
            elif len(rows):
                dim, value, a, b = self.nodes[at]
                left = x[rows, dim] <= value
                todo += [(a, rows[left]), (b, rows[~left])]
        return out


def _matrix(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding array<double>) of the vectors that take part, each once, and their length.

    Out are null ids, null, empty and zero vectors, those with null, NaN or infinite components, and those whose
    length is not the most frequent one (of equally frequent ones, the smallest). Repeated rows count once; of an id with
    several vectors each takes part, and the nearest one counts.
    """
    x = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    x = x.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')) AND exists(embedding, v -> v <> 0)")
    top = x.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = top["n"] if top else 0
    return x.where(F.size("embedding") == width).distinct(), width


def nearest(vectors: DataFrame, k: int, every: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `every`.

    Equal vectors are one point of the index with their k + 1 smallest ids (Spark limits each task's rows per vector
    before the shuffle), so a vector that a third of all rows repeat costs no more than another.
    """
    rows, width = usable(vectors)
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not width:
        return none
    rows = cut(rows)
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    points = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = cut(points.withColumn("point", F.monotonically_increasing_id()))
    total = points.count()
    turn = directions(width)
    limit = min(1.0, 1.5 * SAMPLE / total)
    sample = points.where(F.pmod(F.xxhash64("ids"), F.lit(1 << 30)) < F.lit(int(limit * (1 << 30)))).select("embedding").limit(SAMPLE).toArrow().column(0).combine_chunks()
    tree = Tree(_matrix(sample, width) @ turn, max(1, min(LEAVES, -(-total // LEAF))))

    def place(batches):
        for b in batches:
            p = _matrix(b.column(1), width) @ turn
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(tree.leaf(p)), *(pa.array(p[:, i]) for i in range(M))], names=["point", "embedding", "ids", "leaf", *(f"p{i}" for i in range(M))])

    placed = in_arrow(points.select("point", "embedding", "ids"), place, "point long, embedding array<double>, ids array<long>, leaf long, " + ", ".join(f"p{i} double" for i in range(M)))
    placed = cut(placed)
    boxes = placed.groupBy("leaf").agg(*[f(f"p{i}").alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(M)]).orderBy("leaf").toPandas()  # LEAVES rows at most
    leaf_ids, low, high = boxes["leaf"].to_numpy(), boxes[[f"min{i}" for i in range(M)]].to_numpy(), boxes[[f"max{i}" for i in range(M)]].to_numpy()
    ratio = stop_ratio()

    asked = rows.where(F.col("vec_id") % every == 0)
    queries = cut(placed.join(asked.select("embedding").distinct(), "embedding", "left_semi").select("point", "embedding", "leaf"))
    parts = maybe_broadcast(cut(placed.groupBy("leaf").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))))  # LEAVES rows at most
    index = placed.select(F.col("point").alias("held_point"), F.col("leaf").alias("leaf"), F.col("embedding").alias("vector"), F.col("ids").alias("ids")).join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("held_point"), F.col("parts")).cast("int")).drop("parts", "held_point")

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Each query of a group (with the distance to beat) against the leaf's points."""
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            q, x = _matrix(left["embedding"].combine_chunks(), width), _matrix(right["vector"].combine_chunks(), width)
            pq, px = q @ turn, x @ turn
            ids = right["ids"].to_pylist()
            for i, (point, best) in enumerate(zip(left["point"].to_pylist(), left["best"].to_pylist())):
                d2 = ((px - pq[i]) ** 2).sum(1)
                order = np.argsort(d2, kind="stable")
                found: list[tuple[float, int]] = []
                for at in range(0, len(order), CHUNK):
                    some = order[at : at + CHUNK]
                    if d2[some[0]] > ratio * best * best:
                        break
                    exact = np.sqrt(((x[some] - q[i]) ** 2).sum(1))
                    found += [(float(e), v) for e, j in zip(exact, some) if e <= best for v in ids[j]]
                    found = sorted(found)[: k + 1]
                    if len(found) > k:
                        best = min(best, found[-1][0])
                out_q += [point] * len(found)
                out_s += [s for s, _ in found]
                out_v += [v for _, v in found]
        return pa.table({"point": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    def visit(todo: DataFrame) -> DataFrame:
        """Searches (point, leaf, best): every part of the leaf meets the leaf's queries, in blocks."""
        todo = cut(todo)
        blocks = maybe_broadcast(cut(todo.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))))  # LEAVES rows at most
        asks = todo.join(queries.select("point", "embedding"), "point").join(parts, "leaf").join(blocks, "leaf")
        asks = asks.withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        held = index.join(blocks, "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asks, held = asks.select("leaf", "part", "block", "point", "embedding", "best"), held.select(F.col("leaf").alias("leaf"), F.col("part").alias("part"), F.col("block").alias("block"), "vector", F.col("ids").alias("ids"))
        return asks.groupBy("leaf", "part", "block").cogroup(held.groupBy("leaf", "part", "block")).applyInArrow(search, "point long, vec_id long, score double")

    def merged(found: DataFrame) -> DataFrame:
        """The k + 1 best ids of each query; an id with several vectors counts by its nearest."""
        one = found.groupBy("point", "vec_id").agg(F.min("score").alias("score"))
        return one.withColumn("n", F.row_number().over(Window.partitionBy("point").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1).drop("n")

    def further(first: int, last: int | None):
        """Leaves of a query in the order of their boxes' projected distance, from place first to last, up to the test."""

        def run(batches):
            for b in pieces(batches, 16):  # 16 x LEAVES x M numbers at once
                p, best = _matrix(b.column(1), width) @ turn, np.asarray(b.column(2))
                gap = np.maximum(np.maximum(low[None] - p[:, None], p[:, None] - high[None]), 0)
                d2 = (gap**2).sum(2)
                rank = np.argsort(np.argsort(d2, axis=1, kind="stable"), axis=1, kind="stable")
                go = (d2 <= ratio * (best**2)[:, None]) & (rank >= first) & (rank < (last or len(leaf_ids)))
                i, j = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(leaf_ids[j]), pa.array(best[i])], names=["point", "leaf", "best"])

        return run

    best = None
    for first, last in ((0, 1), (1, 5), (5, None)):
        if first and first >= len(leaf_ids):
            break
        if best is None:
            state = queries.withColumn("best", F.lit(float("inf")))
        else:
            worst = best.groupBy("point").agg(F.when(F.count("*") > k, F.max("score")).otherwise(F.lit(float("inf"))).alias("best"))
            state = queries.join(worst, "point", "left").withColumn("best", F.coalesce("best", F.lit(float("inf"))))
        found = visit(in_arrow(state.select("point", "embedding", "best"), further(first, last), "point long, leaf long, best double"))
        best = cut(merged(found if best is None else best.unionByName(found)))
    own = asked.join(queries.select("point", "embedding"), "embedding").select(F.col("vec_id").alias("query_id"), "point")
    out = own.join(best, "point").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op10(spark, vectors: DataFrame) -> DataFrame:
    """The contract of op10_nearest: see nearest() and usable() for what takes part; ties go to the smaller id."""
    return nearest(vectors, 10, 100)
