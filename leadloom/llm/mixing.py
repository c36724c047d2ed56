"""Mixing sources to target weights: Pareto order sampling, DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5  # of all sizes
MOST = 2.0  # copies of a document at most
BUCKETS = 4096  # of a source's sampling order, at least; only the one in which its target falls is ranked row by row
BUCKET_ROWS = 50_000  # of a bucket, about, at most
LONG = 16  # how fast inclusion odds fall with a document's share of the words still to sample
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source.

    Sources by code point, null last, take the weights in turn. `share` of all sizes is dealt by weight; no target
    exceeds `most` times its source's size, and the excess is dealt again by weight until none is above. That fixed
    point is a water level: in the order of cap / weight sources fill up first, so the level is what is left beyond
    the full ones over the weights of the rest, at the first source that stays below its cap.
    These windows run over one row per source, never over documents, but in one task: `source` is taken to name some
    thousands of places at most, not a place for each document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.greatest(F.lit(BUCKETS), F.ceil(F.count("*") / BUCKET_ROWS)).cast("long").alias("buckets"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn.cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    full, rest, every = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing), up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / F.sum("w").over(rest)
    per = per.withColumn("level", level)
    level = F.first(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")), ignorenulls=True).over(every)
    return per.withColumn("level", level).select("source", "source_size", "buckets", F.least("cap", F.coalesce(F.col("level") * F.col("w"), "cap")).alias("target"))


def _order() -> tuple[Column, Column]:
    """(bucket, sampling key) of a row joined with its source's plan columns.

    The key is Pareto's ranking variable, random odds over inclusion odds. Those are the source's own, of the share still
    to sample, divided by 1 + LONG x the document's part of it: documents that alone are a large part come less often. u comes from the id's hash, so reruns agree. Bucketing uses z / (1 + z) of z = q times the source's own odds, which keeps the order within a
    source, lies in [0, 1] and is u but for long documents: whatever a source's share, its rows spread over all buckets.
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.col("id").cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16**13))
    part = F.least(F.greatest(F.col("part"), F.lit(1e-12)), F.lit(1 - 1e-9))
    fewer = F.lit(1.0) + F.col("size") * F.lit(float(LONG)) / F.when(F.col("extra") > 0, F.col("extra")).otherwise(F.lit(1.0))
    q = (u / (1 - u)) / ((part / (1 - part)) / fewer)
    z = q * (part / (1 - part))
    return F.floor(z / (1 + z) * F.col("buckets")).cast("long"), q


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    p = plan.withColumnRenamed("source", "plan_source")
    bucket, q = _order()
    return rows.withColumn("id", F.coalesce(F.col("doc_id"), F.lit(-1))).join(maybe_broadcast(p), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source").withColumn("q", q).withColumn("bucket", bucket)


def mixing_plan(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source from (doc_id, source, size, place): target, certain whole copies, and where its sample ends.

    A document is expected target / source_size times: the whole part is allocated for certain, the rest is a sample
    of fixed size (in words) taken in Pareto order. Words are summed per (source, bucket) before any ranking; only the
    documents of the one bucket in which the sample ends are ranked, so a hot source is never sorted in one task.
    Documents without words are never the end: they change no sum, and go where their bucket and key fall.
    The document at the end is taken if that brings the source nearer to its target. Rows that repeat its id and size
    have the same odds: as many of them are taken as bring the source nearest, in the order of the hash of their place.
    A source with nothing left to sample (at its cap, say) takes no part in this.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = source_targets(sizes, weights, share, most).withColumn("whole", F.floor(rate).cast("int"))
    plan = cut(plan.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("part", F.when(F.col("source_size") > 0, F.col("extra") / F.col("source_size")).otherwise(F.lit(0.0))))
    rows = _joined(sizes.select("doc_id", "source", "size", "place"), plan.where("extra > 0"))
    binned = rows.groupBy("source", "bucket", "extra").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source").orderBy("bucket")
    ends = binned.withColumn("upto", F.sum("words").over(w)).where("upto >= extra").groupBy("source").agg(F.min("bucket").alias("end_bucket"), F.min_by(F.col("extra") - (F.col("upto") - F.col("words")), "bucket").alias("room"))
    ends = cut(ends)
    e = maybe_broadcast(ends.withColumnRenamed("source", "end_source"))
    end_rows = rows.join(e, F.col("source").eqNullSafe(F.col("end_source")) & (F.col("bucket") == F.col("end_bucket")))
    last = end_rows.where("size > 0").groupBy("source", "room", "q", "id", "size").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy("q", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("upto", F.sum("words").over(w)).where("upto > room")
    some = F.floor((F.col("room") - F.col("upto") + F.col("words")) / F.col("size") + 0.5).cast("long")  # rows of the last ones that are taken
    last = cut(last.groupBy("source").agg(F.min(F.struct("q", "id", "size", "n", some.alias("some"))).alias("last")))
    split = last.where("last.some > 0 AND last.some < last.n").select(F.col("source").alias("split_source"), "last")
    for name, t in (("end_source", ends), ("last_source", last), ("cut_source", _among_equals(end_rows, split) if not split.isEmpty() else last.select("source", F.lit(None).cast("struct<turn:bigint,place:bigint>").alias("last_turn")))):
        plan = plan.join(t.withColumnRenamed("source", name), F.col("source").eqNullSafe(F.col(name)), "left").drop(name)
    return cut(plan.drop("room"))


def _turn() -> Column:
    return F.pmod(F.xxhash64("place"), F.lit(1 << 40))


def _among_equals(rows: DataFrame, split: DataFrame) -> DataFrame:
    """(source, last_turn): the last of the equal rows at a source's end that is taken, in the order of (turn, place). As
    for the sources themselves, rows are counted by bucket and only those of the last bucket are ranked."""
    same = F.col("source").eqNullSafe(F.col("split_source")) & (F.col("q") == F.col("last.q")) & (F.col("id") == F.col("last.id")) & (F.col("size") == F.col("last.size"))
    equal = rows.join(maybe_broadcast(split), same).select("source", "place", _turn().alias("turn"), F.col("last.some").alias("some"), F.floor(_turn() * F.col("buckets") / float(1 << 40)).alias("part_of_turns"))
    w = Window.partitionBy("source").orderBy("part_of_turns")
    counts = equal.groupBy("source", "part_of_turns", "some").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(w)).where("upto >= some")
    ends = cut(counts.groupBy(F.col("source").alias("turn_source")).agg(F.min("part_of_turns").alias("end_turns"), F.min_by(F.col("some") - F.col("upto") + F.col("n"), "part_of_turns").alias("left")))
    there = equal.join(maybe_broadcast(ends), F.col("source").eqNullSafe(F.col("turn_source")) & (F.col("part_of_turns") == F.col("end_turns")))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("turn", "place"))
    return cut(there.withColumn("rank", rank).where(F.col("rank") <= F.col("left")).groupBy("source").agg(F.max(F.struct("turn", "place")).alias("last_turn")))


def mix(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs (doc_id, source, size, place and any other columns) with the plan's source_size and target, and `copies`, 0 to 2."""
    extra = ["whole", "extra", "part", "buckets", "end_bucket", "last", "last_turn", "q", "bucket", "id"]
    key, last = F.struct("q", "id", "size"), F.struct("last.q", "last.id", "last.size")
    equal = F.coalesce(F.struct(_turn().alias("turn"), F.col("place")) <= F.col("last_turn"), F.col("last.some") > 0)
    inside = F.when(F.col("last").isNull() | (key < last), True).otherwise((key == last) & equal)
    took = F.when(F.col("end_bucket").isNull(), F.col("part") > 0).otherwise((F.col("bucket") < F.col("end_bucket")) | ((F.col("bucket") == F.col("end_bucket")) & inside))
    clash = [c for c in docs.columns if c in {*extra, "source_size", "target", "copies"}]
    return _joined(docs.drop(*clash), plan).withColumn("copies", F.col("whole") + F.coalesce(took, F.lit(False)).cast("int")).drop(*extra)


def op2(spark, docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: see the contract of op2_source_mix.

    Null texts have size 0 and are taken 0 words; a null source is a source of its own; null ids hash as -1; of rows that
    repeat an id and size some may be taken and others not; an empty table gives no rows. Text is read once.
    """
    sizes = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("place")))
    return mix(sizes, mixing_plan(sizes)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, in the columns it came with.

    Null and blank texts have size 0: they take part in no sum and are kept or not as their key falls. A null source is a
    source, null ids hash as -1, repeated rows are taken one by one, no rows give no rows.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("place"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    plan = mixing_plan(cut(rows.select("doc_id", "source", "size", "place")))
    return mix(rows, plan).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("document.*")


#: The same sample in SQL: the same hash, order and end, ranked whole.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(doc_id, -1) AS id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size)::BIGINT * 2.0::DOUBLE AS cap FROM d GROUP BY source),
turn AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM per),
lev AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM turn),
wat AS (SELECT *, (SELECT arg_min(level, cap / w) FROM lev WHERE level * w <= cap) AS water FROM lev),
tar AS (SELECT source, source_size, least(cap, coalesce(water * w, cap)) AS target FROM wat),
pl AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS whole FROM tar),
p2 AS (SELECT *, target - whole * source_size AS extra FROM pl),
p3 AS (SELECT *, CASE WHEN source_size > 0 THEN extra / source_size ELSE 0.0 END AS part FROM p2),
j AS (SELECT d.doc_id, d.id, d.size, p3.*, (('0x' || substr(md5('mix:' || d.id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
    least(greatest(part, 1e-12::DOUBLE), (1 - 1e-9)::DOUBLE) AS share, 1.0::DOUBLE + d.size * 16.0::DOUBLE / CASE WHEN extra > 0 THEN extra ELSE 1.0::DOUBLE END AS fewer
    FROM d JOIN p3 ON d.source IS NOT DISTINCT FROM p3.source),
o AS (SELECT *, (u / (1 - u)) / ((share / (1 - share)) / fewer) AS q FROM j),
g AS (SELECT source, q, id, size, extra, sum(size) AS words FROM o GROUP BY ALL),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY q, id, size) - words / 2 <= extra AS took FROM g)
SELECT o.doc_id, o.size, o.source_size, o.target, ((o.whole + CASE WHEN c.took AND o.part > 0 THEN 1 ELSE 0 END) * o.size)::BIGINT AS taken
FROM o JOIN c ON o.source IS NOT DISTINCT FROM c.source AND o.q = c.q AND o.id = c.id AND o.size = c.size
"""
