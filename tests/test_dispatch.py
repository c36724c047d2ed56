"""The dispatch stream over several runs of one query: retries, late and stale results, timers, restarts."""

from __future__ import annotations

import time

import pytest

from leadloom.streaming import dispatch

DDL = "run_id long, idx int, attempt_id string, seq long, event string, reason string"


@pytest.fixture
def feed(spark, tmp_path):
    """feed(rows, limit): writes rows as a file and runs the query once more from its checkpoint; its new output."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = set()

    def run(rows, limit=3_600_000):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = dispatch.dispatched(spark.readStream.schema(DDL).parquet(str(tmp_path / "in")), limit)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
        try:  # with timers the query never runs out of batches: it is stopped once the file is in and a batch has followed
            until = time.time() + 90
            while time.time() < until and q.exception() is None:
                done = [p for p in q.recentProgress if p.numInputRows]
                if done and q.lastProgress.batchId > done[-1].batchId:
                    break
                time.sleep(0.2)
            assert q.exception() is None
        finally:
            q.stop()
        every = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("run_id", "idx", "attempt_id", "seq", "state", "reason", "attempts", "reasons").collect()}
        new = every - seen
        seen.update(new)
        return new

    yield run
    spark.conf.set(name, before)


def test_attempts_over_restarts(feed):
    out = feed([(1, 0, "a", 1, "dispatch", None), (1, 0, "old", 2, "ready", None), (1, 1, "x", 3, "ready", None), (2, 0, "z", 4, "dispatch", None), (2, 0, "z", 5, "failed", "IDENTITY_MISMATCH")])
    assert out == {(1, 0, "a", 1, "DISPATCHED", None, 1, ""), (1, 0, "old", 2, "REJECTED", "stale_attempt", 1, ""), (1, 1, "x", 3, "REJECTED", "unknown_candidate", 0, ""), (2, 0, "z", 4, "DISPATCHED", None, 1, ""), (2, 0, "z", 5, "FAILED", "IDENTITY_MISMATCH", 1, "IDENTITY_MISMATCH")}
    out = feed([(1, 0, "b", 6, "dispatch", None), (1, 0, "a", 7, "ready", None), (1, 0, "b", 8, "ready", None), (1, 0, "b", 9, "failed", "x"), (2, 0, "y", 10, "dispatch", None)])
    assert out == {(1, 0, "b", 6, "DISPATCHED", None, 2, ""), (1, 0, "a", 7, "REJECTED", "stale_attempt", 2, ""), (1, 0, "b", 8, "READY", None, 2, ""), (1, 0, "b", 9, "REJECTED", "already_terminal", 2, ""), (2, 0, "y", 10, "REJECTED", "already_terminal", 1, "IDENTITY_MISMATCH")}


def test_timers(feed):
    out = feed([(1, 0, "a", 1, "dispatch", None), (1, 1, "b", 2, "dispatch", None), (1, 1, "b", 3, "skipped", None)], limit=500)
    time.sleep(1)
    out |= feed([(9, 9, "q", 4, "dispatch", None)], limit=500)
    assert (1, 0, "a", -1, "FAILED", dispatch.TIMEOUT, 1, dispatch.TIMEOUT) in out and [r[4] for r in sorted(out, key=lambda r: r[3]) if r[:2] == (1, 1)] == ["DISPATCHED", "SKIPPED"]
    out = feed([(1, 0, "a", 5, "ready", None)], limit=500)
    assert (1, 0, "a", 5, "REJECTED", "already_terminal", 1, dispatch.TIMEOUT) in out
