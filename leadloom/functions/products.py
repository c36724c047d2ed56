"""All pairs of ids, made from blocks of ids: what is shuffled are blocks, and pairs come up where they leave the task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ids of a block, or so; ids of a run. Two runs' pairs are held at once, and are coded by their repeats in a file.
BLOCK = 4096
RUN = 64


def blocked(members: DataFrame, cell: str) -> DataFrame:
    """`members` (cell, id, ...) with `block`: a cell's ids are spread over as many blocks as it fills. Only the sizes of cells
    of several blocks are broadcast, a row for BLOCK members at most."""
    n = members.groupBy(cell).agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK)
    return members.join(F.broadcast(n), cell, "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / BLOCK)), F.lit(0))).drop("_n")


def ids() -> Column:
    """The ids of a group as a sorted array, so that runs of two blocks seldom overlap."""
    return F.array_sort(F.collect_list("id"))


def each(c: Column) -> Column:
    """Explode that hands on one row at a time; a generated one holds all rows of an array, with what stands beside it."""
    return F.explode(F.transform(c, lambda e: e))


def _runs(c: str) -> Column:
    return each(F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / RUN).cast("int")), lambda k: F.slice(c, k * RUN + 1, F.lit(RUN))))


def products(tiles: DataFrame, x: str, y: str, runs_where: str = "true") -> DataFrame:
    """`tiles` with arrays x and y: a row for each pair of their elements, in place of them. Runs of the arrays that fail
    `runs_where` are left out before their pairs are made."""
    rest = [c for c in tiles.columns if c not in (x, y)]
    runs = tiles.select(*rest, y, _runs(x).alias(x)).select(*rest, x, _runs(y).alias(y)).where(runs_where)
    return runs.select(*rest, y, F.explode(x).alias(x)).select(*rest, x, F.explode(y).alias(y))
