"""Jobs tracked over a stream of their events: one value state per job, deadlines and forgetting by event-time timers.

A job's first event starts its deadline.  A running job that the watermark finds past it is reported once as failed with TIMED_OUT, and no later
event of it counts.  A job that has ended is kept for ``keep`` more, so repeated and late events of it are known as such, and then
forgotten; so the state holds the jobs of the last deadline and keeping time, not all there ever were.  ``settled`` says the same of a table.

The session's state store must be one that keeps timers: ``spark.sql.streaming.stateStore.providerClass`` set to RocksDB's.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexweave.operators.jobs import STATUSES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRACKED = "job_id string, stage string, status string, progress double, updated_at timestamp, code string, seconds double"
TIMED_OUT = "TIMED_OUT"
FAILED = STATUSES[-1]
_STATE = "stage string, status string, progress double, updated_at timestamp, started_at timestamp, timer bigint"


def _at(milliseconds: int) -> datetime:
    return datetime.fromtimestamp(milliseconds / 1000, timezone.utc).replace(tzinfo=None)


def _milliseconds(t: datetime) -> int:
    return round(t.replace(tzinfo=timezone.utc).timestamp() * 1000)


class JobTracker(StatefulProcessor):
    def __init__(self, deadline: timedelta, keep: timedelta):
        self.deadline, self.keep = deadline, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", _STATE)

    def _store(self, stage: str, status: str, progress: float, updated: datetime, started: datetime, timer: int | None) -> None:
        """The state with its one timer: the deadline of a running job, the forgetting of an ended one."""
        at = _milliseconds(updated + self.keep if status in STATUSES else started + self.deadline)
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
        self.state.update((stage, status, progress, updated, started, at))

    def _row(self, key, stage, status, progress, updated, started, code) -> pd.DataFrame:
        seconds = (updated - started).total_seconds()
        return pd.DataFrame({"job_id": [key[0]], "stage": [stage], "status": [status], "progress": [progress], "updated_at": [updated], "code": [code], "seconds": [seconds]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = []
        for batch in rows:
            stamps = batch["updated_at"].dt.tz_localize(None) if batch["updated_at"].dt.tz is not None else batch["updated_at"]
            events += zip(stamps.dt.to_pydatetime(), batch["progress"].astype(float), batch["stage"], batch["status"])
        if not events:
            return
        held = self.state.get() if self.state.exists() else None
        timer = held[5] if held else None
        if held and held[1] in STATUSES:
            return
        first, limit = min(e[0] for e in events), None
        started = min(first, _naive(held[4])) if held else first
        limit = started + self.deadline
        # What comes after the deadline is the timer's to report; the first end counts.
        timely = sorted(e for e in events if e[0] <= limit)
        ended = [e for e in timely if e[3] in STATUSES]
        if not timely:
            if held:
                return
            timely = [(first, 0.0, events[0][2], events[0][3])]
        updated, progress, stage, status = ended[0] if ended else timely[-1]
        if held and not ended and (updated, progress) <= (_naive(held[3]), held[2]):
            return
        self._store(stage, status, progress, updated, started, timer)
        yield self._row(key, stage, status, progress, updated, started, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.state.exists():
            return
        stage, status, progress, _, started, timer = self.state.get()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        if status in STATUSES:
            self.state.clear()
            return
        at = _at(timer)
        self._store(stage, FAILED, progress, at, _naive(started), None)
        yield self._row(key, stage, FAILED, progress, at, _naive(started), TIMED_OUT)

    def close(self) -> None:
        pass


def _naive(t) -> datetime:
    t = t.to_pydatetime() if isinstance(t, pd.Timestamp) else t
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def tracked(events: DataFrame, deadline: timedelta, keep: timedelta = timedelta(days=1), late: str = "10 minutes") -> DataFrame:
    """TRACKED rows of a stream of events (job_id, stage, status, progress, updated_at): each change of a job, its end, or its TIMED_OUT."""
    given = events.where("job_id IS NOT NULL AND updated_at IS NOT NULL").select("job_id", "stage", "status", F.coalesce("progress", F.lit(0.0)).alias("progress"), "updated_at")
    grouped = given.withWatermark("updated_at", late).groupBy("job_id")
    return grouped.transformWithStateInPandas(JobTracker(deadline, keep), TRACKED, "Update", "EventTime")


def settled(events: DataFrame, deadline: timedelta, now: datetime) -> DataFrame:
    """TRACKED: of a table of events how each job stands at ``now``: its first end within the deadline, TIMED_OUT, or its last event."""
    given = events.where("job_id IS NOT NULL AND updated_at IS NOT NULL").withColumn("progress", F.coalesce("progress", F.lit(0.0)))
    given = given.withColumn("started", F.min("updated_at").over(Window.partitionBy("job_id")))
    limit = F.col("started") + F.expr(f"INTERVAL {int(deadline.total_seconds() * 1000)} MILLISECOND")
    timely, over = F.col("updated_at") <= limit, F.lit(now) > limit
    event = F.struct("updated_at", "progress", "stage", "status")
    rows = given.where(timely).groupBy("job_id", "started", limit.alias("limit")).agg(F.min(F.when(F.col("status").isin(*STATUSES), event)).alias("end"), F.max(event).alias("last"))
    late = F.col("end").isNull() & (F.lit(now) > F.col("limit"))
    pick = lambda c: F.coalesce(F.col(f"end.{c}"), F.col(f"last.{c}"))
    at = F.when(late, F.col("limit")).otherwise(pick("updated_at"))
    return rows.select(
        "job_id", pick("stage").alias("stage"), F.when(late, FAILED).otherwise(pick("status")).alias("status"), pick("progress").alias("progress"), at.alias("updated_at"),
        F.when(late, TIMED_OUT).alias("code"), (at.cast("double") - F.col("started").cast("double")).alias("seconds"),
    )
