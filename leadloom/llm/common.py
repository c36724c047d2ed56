"""Helpers shared by the training-data operators: table access, lineage cuts, Arrow loops, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when its counted rows, and those times the bytes of a row, stay below these; beyond them the
#: join shuffles.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

#: Bytes of an Arrow batch on its way to a Python worker, and rows that a worker turns into Python objects at once.
BATCH_BYTES = 8 << 20
SLICE = 256

#: `[^\x20\x09-\x0D]+` is a word for the mixing and join operators.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one is set only in local mode, where one machine does all the work."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="leadloom-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so a lost executor costs no recomputation upstream."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def narrow(df: DataFrame) -> DataFrame:
    """Few partitions for what is far smaller than the input: as many as the cluster has cores, 8 at least."""
    return df.coalesce(max(8, df.sparkSession.sparkContext.defaultParallelism))


_WIDTH = {"boolean": 1, "tinyint": 1, "int": 4, "float": 4, "bigint": 8, "double": 8}


def maybe_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast hint behind a count and the bytes of its rows (measured where a column has no fixed width); a larger side
    is left to Spark's shuffle joins (skew handled by AQE)."""
    loose = [c for c, t in df.dtypes if t not in _WIDTH]
    size = sum(8 + _WIDTH.get(t, 0) for _, t in df.dtypes)
    if loose:
        text = sum((F.coalesce(F.length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0)) for c in loose), F.lit(0))
        found = df.agg(F.count("*"), F.coalesce(F.sum(text), F.lit(0))).first()
        rows, more = found[0], found[1]
    else:
        rows, more = df.count() if rows is None else rows, 0
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * size + more <= BROADCAST_BYTES else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of `[^\\x20\\x09-\\x0D]+` matches; empty for null and blank texts."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), BLANKS), lambda w: w != "")


def release() -> None:
    """Gives what a task has freed back to the system: Python workers live on between tasks, beside the JVM's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """mapInArrow with batches bounded in bytes, for which the session is set to BATCH_BYTES."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, ddl)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that only those are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable], schema: pa.Schema, spark_schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow over `columns`: make() builds, once a task, a function from column lists to output lists; done() ends it.

    Memory is bounded by an Arrow batch of BATCH_BYTES (or one row) and the Python objects of SLICE rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for part in pieces(batches):
            out = f(*[part.column(i).to_pylist() for i in range(len(columns))])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types, strict=True)], schema=schema)
        del f
        if done is not None:
            done()
        release()

    return in_arrow(df.select(*columns), run, spark_schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (u, v: long) that has a link: label is the smallest node id reachable.

    Alternating large-star and small-star rounds; every round is two aggregations and joins on the node id
    (aggregations combine before the shuffle, AQE splits hub nodes in the joins) and ends in a checkpoint. A graph
    small enough to broadcast is joined without shuffles and kept in few partitions.
    """
    e = cut(narrow(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
    seen = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v").distinct())
        seen, few = now, now[0] <= BROADCAST_ROWS
        near = F.broadcast if few else lambda t: t  # two numbers a row
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(near(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = narrow(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(near(down), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        e = cut(narrow(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))


def cut_table(df: DataFrame) -> DataFrame:
    """Like cut, as Parquet: for tables of many rows, whose columns get much smaller that way."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
