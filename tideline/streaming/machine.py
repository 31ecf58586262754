"""Reports as a state machine: pending, processing, completed or failed, with legal changes only and a time limit.

The state of a report is kept by Spark's state store, so a restart goes on where the last run ended. Events that are no
legal change are told apart, not lost. A report that is in processing for too long fails by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# States, and those that may follow each; a report is new before its first event.
NEXT = {
    "new": ("pending",),
    "pending": ("processing",),
    "processing": ("completed", "failed"),
    "completed": (),
    "failed": ("pending",),
}
CHANGES = "report string, at timestamp, was string, status string, outcome string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Reports(StatefulProcessor):
    """Takes rows (report, at, seq, status) of a report; gives a row for each: was, status, and whether it was `done`,
    `repeated` (the status it had) or `refused`; and `timed out` for one that failed by the clock."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, since long")

    def _keep(self, status: str, since: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.state.update((status, since))
        if status == "processing":
            self.handle.registerTimer(since + self.limit_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # what came in this batch; the state before it is one value
        events = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        now = self.state.get()[0] if self.state.exists() else "new"
        out = []
        for at, status in zip(events["at"], events["status"], strict=True):
            legal = status in NEXT.get(now, ())
            out.append((key[0], at, now, status, "done" if legal else "repeated" if status == now else "refused"))
            if legal:
                now = status
                self._keep(status, int(at.timestamp() * 1000))
        yield pd.DataFrame(out, columns=["report", "at", "was", "status", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.state.exists() and self.state.get()[0] == "processing":
            self.state.update(("failed", at))
            yield pd.DataFrame([(key[0], pd.Timestamp(at, unit="ms"), "processing", "failed", "timed out")], columns=["report", "at", "was", "status", "outcome"])

    def close(self) -> None:
        pass


def status_changes(events: DataFrame, limit: str = "10 minutes", late: str = "0 seconds") -> DataFrame:
    """A stream of changes from a stream of events (report, at, seq, status), by event time: a report that the watermark
    finds in processing for longer than `limit` fails. Rows without report, time or status are left out. Set the state
    store provider to PROVIDER."""
    ms = pd.Timedelta(limit) // pd.Timedelta("1ms")
    rows = events.where("report is not null and at is not null and status is not null").withWatermark("at", late)
    return rows.groupBy("report").transformWithStateInPandas(Reports(ms), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def state_of(changes: DataFrame) -> DataFrame:
    """(report, status, since) of a table of changes: the last that took effect."""
    effect = changes.where(F.col("outcome").isin("done", "timed out"))
    return effect.groupBy("report").agg(F.max_by("status", F.struct("at", "was")).alias("status"), F.max("at").alias("since"))
