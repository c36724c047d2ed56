"""The run queue as a stream: candidate events folded to terminal states with write-once results and timeouts.

Staleness is by identity (the attempt an event names), not by time. State is one small row a run and candidate; what has
ended is remembered for KEPT_MS of event time after its last event, so that a later event can't reopen it, and then
dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "run_id long, idx int, attempt_id string, state string, seq long"
STATE = "attempt_id string, state string"
LIMIT_MS = 15_000  # of a dispatched attempt
KEPT_MS = 24 * 3600 * 1000  # for which an ended candidate stays closed


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State changes of one candidate: DISPATCHED by an attempt, then the first READY or FAILED of the live attempt."""
    run_id, idx = key
    if state.hasTimedOut:
        attempt, now = state.get
        if now != "DISPATCHED":
            state.remove()
        else:
            state.update((attempt, "FAILED"))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + KEPT_MS)
            yield pd.DataFrame({"run_id": [run_id], "idx": [idx], "attempt_id": [attempt], "state": ["FAILED"], "seq": [-1]})
        return
    attempt, now = state.get if state.exists else (None, "PENDING")
    out = []
    for row in pd.concat(list(batches)).sort_values("seq").itertuples():
        if now in ("READY", "FAILED"):
            continue
        if row.event == "dispatch":
            attempt, now = row.attempt_id, "DISPATCHED"
        elif row.attempt_id == attempt and now == "DISPATCHED":
            now = "READY" if row.event == "ready" else "FAILED"
        else:
            continue
        out.append((run_id, idx, attempt, now, row.seq))
    state.update((attempt, now))
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + (LIMIT_MS if now == "DISPATCHED" else KEPT_MS))
    if out:
        yield pd.DataFrame(out, columns=["run_id", "idx", "attempt_id", "state", "seq"])


def candidate_states(events: DataFrame) -> DataFrame:
    """Changes of candidate states from a stream of (run_id, idx, attempt_id, seq, ts, event: dispatch, ready, failed)."""
    rows = events.withWatermark("ts", "15 seconds")
    return rows.groupBy("run_id", "idx").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def first_by_place(results: DataFrame, late: str = "1 hour") -> DataFrame:
    """READY results without those whose place id came before in their run."""
    return results.where("place_id IS NOT NULL").withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "place_id"])


def debounced(updates: DataFrame, gap: str = "400 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Last update of each burst of a run: session windows closed by a gap."""
    return updates.withWatermark("ts", late).groupBy("run_id", F.session_window("ts", gap)).agg(F.max_by("seq", "ts").alias("seq"), F.count("*").alias("updates"))
