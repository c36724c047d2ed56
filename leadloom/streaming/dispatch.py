"""The dispatch of candidates as a stateful stream: attempts, timers, write-once results and recorded reasons.

A candidate of a run has one live attempt. A dispatch starts it and a timer; a further dispatch (a retry after the page
was connected anew) replaces it; its first result, or its timer, ends it for good. Results of other attempts, of ended
candidates and of those never dispatched are rejected by identity, not by time, and a timer of a replaced attempt is
ignored. State is a row and a short list of reasons a candidate; KEPT after its last change it is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "run_id long, idx int, attempt_id string, seq long, state string, reason string, attempts int, reasons string"
LIMIT_MS = 15_000  # of an attempt
KEPT_MS = 24 * 3600 * 1000  # for which a candidate that doesn't change is remembered
TIMEOUT = "CANDIDATE_TIMEOUT"
ENDED = ("READY", "FAILED", "DUPLICATE_SKIPPED", "SKIPPED")


class Dispatch(StatefulProcessor):
    def __init__(self, limit_ms: int = LIMIT_MS, kept_ms: int = KEPT_MS):
        self.limit, self.kept = limit_ms, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "attempt string, state string, deadline long, attempts int", self.kept)
        self.reasons = handle.getListState("reasons", "reason string", self.kept)

    def _get(self) -> tuple[str | None, str, int, int]:
        got = self.now.get() if self.now.exists() else None
        return tuple(got) if got is not None else (None, "PENDING", 0, 0)

    def _row(self, key: Any, attempt: str | None, seq: int, state: str, reason: str | None) -> tuple:
        told = ",".join(r[0] for r in self.reasons.get()) if self.reasons.exists() else ""
        return (*key, attempt, seq, state, reason, self._get()[3], told)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            attempt, state, deadline, attempts = self._get()
            reason = row.reason if isinstance(row.reason, str) and row.reason else None
            if row.event == "dispatch":
                if state in ENDED:
                    out.append(self._row(key, row.attempt_id, row.seq, "REJECTED", "already_terminal"))
                    continue
                if state == "DISPATCHED":
                    self.handle.deleteTimer(deadline)
                deadline = timerValues.getCurrentProcessingTimeInMs() + self.limit
                self.handle.registerTimer(deadline)
                self.now.update((row.attempt_id, "DISPATCHED", deadline, attempts + 1))
                out.append(self._row(key, row.attempt_id, row.seq, "DISPATCHED", None))
            elif state != "DISPATCHED" or row.attempt_id != attempt:
                why = "already_terminal" if state in ENDED else "unknown_candidate" if state == "PENDING" else "stale_attempt"
                out.append(self._row(key, row.attempt_id, row.seq, "REJECTED", why))
            else:
                self.handle.deleteTimer(deadline)
                end = {"ready": "READY", "duplicate": "DUPLICATE_SKIPPED", "skipped": "SKIPPED"}.get(row.event, "FAILED")
                if end == "FAILED":
                    self.reasons.appendValue((reason or "UNKNOWN",))
                self.now.update((attempt, end, 0, attempts))
                out.append(self._row(key, attempt, row.seq, end, reason if end == "FAILED" else None))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        attempt, state, deadline, attempts = self._get()
        if state == "DISPATCHED" and expiredTimerInfo.getExpiryTimeInMs() == deadline:
            self.reasons.appendValue((TIMEOUT,))
            self.now.update((attempt, "FAILED", 0, attempts))
            yield pd.DataFrame([self._row(key, attempt, -1, "FAILED", TIMEOUT)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def dispatched(events: DataFrame, limit_ms: int = LIMIT_MS, kept_ms: int = KEPT_MS) -> DataFrame:
    """Changes and rejections of candidates from a stream of (run_id, idx, attempt_id, seq, event: dispatch, ready, failed,
    duplicate or skipped, reason). The session's state store must be the RocksDB one."""
    rows = events.select("run_id", "idx", "attempt_id", "seq", "event", "reason")
    return rows.groupBy("run_id", "idx").transformWithStateInPandas(Dispatch(limit_ms, kept_ms), OUTPUT, "Append", "ProcessingTime")
