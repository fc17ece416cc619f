"""Leases of jobs as a stream: a timer takes back what a worker has not renewed, without a new row of that job.

The state of a job holds its last row and its attempts; a running job has a timer at the end of its lease in event time, which
a heartbeat, another running row, puts off. As the stream's time passes it, the job waits again, or has failed after its last attempt.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "id long, attempts int, state string, at timestamp, run_after timestamp, expired boolean"


class Leases(StatefulProcessor):
    def __init__(self, lease: int, most: int):
        self.lease, self.most = lease, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int, at long")

    def _row(self, key, attempts: int, state: str, at: int, run_after: int | None, expired: bool) -> pd.DataFrame:
        time = lambda x: pd.NaT if x is None else pd.Timestamp(x, unit="us")
        return pd.DataFrame({"id": [key[0]], "attempts": [attempts], "state": [state], "at": [time(at)], "run_after": pd.Series([time(run_after)], dtype="datetime64[us]"), "expired": [expired]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        newest = max(zip(frame["at"].astype("datetime64[us]").astype("int64"), frame["attempts"], frame["status"]))
        old = self.job.get()
        if old is not None and (old[2], old[1], old[0]) > newest:
            return  # late rows change nothing
        at, attempts, status = int(newest[0]), int(newest[1]), newest[2]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.job.update((status, attempts, at))
        if status == "running":
            self.handle.registerTimer(at // 1000 + 1000 * self.lease)
        again = status == "failed" and attempts < self.most
        yield self._row(key, attempts, "waiting" if again else status, at, at + attempts * attempts * 60_000_000 if again else None, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts, at = self.job.get()
        if status == "running":
            state = "waiting" if attempts < self.most else "failed"
            self.job.update((state, attempts, at))
            yield self._row(key, attempts, state, at, None, True)


def leases(jobs: DataFrame, late: str = "0 seconds", lease: int = 90, most: int = 5) -> DataFrame:
    """(id, attempts, state, at, run_after, expired): a row whenever a job's state changes, by a new row of the stream jobs
    (id, status, attempts, at) or, with expired, by its timer. A job's last row is its state at the stream's time; rows older than
    a job's last are passed over. The session must keep state in RocksDB (STATE_STORE)."""
    own = jobs.select("id", "status", "attempts", "at").where("id is not null and at is not null").withWatermark("at", late)
    return own.groupBy("id").transformWithStateInPandas(Leases(lease, most), SCHEMA, "Update", "EventTime")
