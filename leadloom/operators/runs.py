"""Run events folded to candidate states and counters, and the windows over them, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIMEOUT = 15.0  # seconds a dispatched candidate may take
TERMINAL = ("READY", "FAILED", "DUPLICATE_SKIPPED")


def _seconds(c: Column) -> Column:
    """A timestamp (with or without zone) as seconds."""
    return F.unix_micros(c.cast("timestamp")) / 1e6


def accepted(results: DataFrame, dispatches: DataFrame) -> DataFrame:
    """Results with their verdict: `accepted`, or why they are stale.

    results (run_id, idx, attempt_id, seq, query), dispatches (run_id, idx, attempt_id, seq, query). A result counts if
    it names the latest attempt dispatched for its candidate before it, the run's query, and is the first to do so.
    """
    d = dispatches.select("run_id", "idx", "seq", F.struct(F.col("attempt_id").alias("live"), F.col("query").alias("d_query")).alias("own"))
    r = results.withColumn("own", F.lit(None).cast(d.schema["own"].dataType)).withColumn("is_result", F.lit(True))
    both = r.unionByName(d.withColumn("is_result", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy("run_id", "idx").orderBy("seq", F.desc("is_result")).rowsBetween(Window.unboundedPreceding, -1)
    r = both.withColumn("d", F.last("own", ignorenulls=True).over(before)).where("is_result").select(*results.columns, "d")
    verdict = F.when(F.col("d.live").isNull(), F.lit("unknown_candidate")).when(F.col("d.live") != F.col("attempt_id"), F.lit("stale_attempt")).when(F.col("d.d_query") != F.col("query"), F.lit("stale_query")).otherwise(F.lit("ok"))
    r = r.withColumn("verdict", verdict).drop("d")
    nth = F.row_number().over(Window.partitionBy("run_id", "idx", "verdict").orderBy("seq"))
    return r.withColumn("verdict", F.when((F.col("verdict") == "ok") & (nth > 1), F.lit("already_terminal")).when(F.col("verdict") == "ok", F.lit("accepted")).otherwise(F.col("verdict")))


def first_terminal(events: DataFrame) -> DataFrame:
    """(run_id, idx, state): the first terminal state of each candidate; later ones change nothing."""
    t = events.where(F.col("state").isin(*TERMINAL))
    return t.groupBy("run_id", "idx").agg(F.min_by("state", "seq").alias("state"))


def skip_duplicates(results: DataFrame) -> DataFrame:
    """READY results whose place id came before in their run become DUPLICATE_SKIPPED."""
    nth = F.row_number().over(Window.partitionBy("run_id", "place_id").orderBy("seq"))
    again = (F.coalesce(F.col("place_id"), F.lit("")) != "") & (nth > 1) & (F.col("state") == "READY")
    return results.withColumn("state", F.when(again, F.lit("DUPLICATE_SKIPPED")).otherwise(F.col("state")))


def timed_out(events: DataFrame, limit: float = TIMEOUT) -> DataFrame:
    """Events with gap (seconds to the run's next event; null for the last) and whether it exceeds the limit."""
    gap = _seconds(F.lead("ts").over(Window.partitionBy("run_id").orderBy("ts", "seq"))) - _seconds(F.col("ts"))
    return events.withColumn("gap", gap).withColumn("timed_out", F.coalesce(F.col("gap") > limit, F.lit(False)))


def sessions(events: DataFrame, column: str = "query") -> DataFrame:
    """Numbers the stretches of one normalized query within a run: a change resets the session."""
    w = Window.partitionBy("run_id").orderBy("ts", "seq")
    changed = F.coalesce((F.lag(column).over(w) != F.col(column)).cast("int"), F.lit(0))
    return events.withColumn("changed", changed).withColumn("session", F.sum("changed").over(w)).drop("changed")


def debounce(events: DataFrame, gap: float) -> DataFrame:
    """Last event of each burst: events of a run that follow one another within `gap` seconds."""
    w = Window.partitionBy("run_id").orderBy("ts", "seq")
    start = F.coalesce((_seconds(F.col("ts")) - _seconds(F.lag("ts").over(w)) > gap).cast("int"), F.lit(0))
    b = events.withColumn("start", start).withColumn("burst", F.sum("start").over(w))
    return b.groupBy("run_id", "burst").agg(F.max_by("seq", F.struct("ts", "seq")).alias("seq"), F.count("*").alias("events"))


def run_stats(states: DataFrame) -> DataFrame:
    """Counters of each run from candidate states."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s.lower())
    return states.groupBy("run_id").agg(F.count("*").alias("discovered"), n("READY"), n("FAILED"), n("DUPLICATE_SKIPPED"), n("PENDING"))


def progress(events: DataFrame) -> DataFrame:
    """Running share of finished candidates after each event, in whole per cent."""
    w = Window.partitionBy("run_id").orderBy("ts", "seq")
    total = F.count("*").over(Window.partitionBy("run_id"))
    done = F.sum(F.col("state").isin(*TERMINAL).cast("int")).over(w)
    return events.withColumn("done", done).withColumn("percent", F.floor(F.col("done") * 100 / total).cast("long"))
