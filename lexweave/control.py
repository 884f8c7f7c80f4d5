"""Deadlines and cancellation of jobs: Spark jobs carry a tag, by which a timer, a signal or another thread stops them."""

from __future__ import annotations

import signal
import threading
import time
import uuid

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    pass


class TimedOut(RuntimeError):
    pass


class Job:
    """``with Job(spark, seconds=60) as job:`` tags the Spark jobs started in the block, and stops them at the deadline.

    ``check(stage)`` raises between stages; leaving the block after a stop raises too, in place of Spark's own error.
    """

    def __init__(self, spark: SparkSession, seconds: float | None = None, signals: bool = False):
        self.context, self.seconds, self.signals = spark.sparkContext, seconds, signals
        self.tag = f"job-{uuid.uuid4().hex}"
        self.why: str | None = None
        self.stage = ""
        self._before: dict = {}
        self._timer: threading.Timer | None = None

    def __enter__(self) -> Job:
        self.started = time.monotonic()
        self.context.addJobTag(self.tag)
        if self.seconds is not None:
            self._timer = threading.Timer(self.seconds, self._stop, ("timeout",))
            self._timer.daemon = True
            self._timer.start()
        if self.signals and threading.current_thread() is threading.main_thread():
            for s in (signal.SIGTERM, signal.SIGINT):
                self._before[s] = signal.signal(s, lambda *_: threading.Thread(target=self.cancel).start())
        return self

    def __exit__(self, kind, error, trace) -> None:
        if self._timer is not None:
            self._timer.cancel()
        for s, handler in self._before.items():
            signal.signal(s, handler)
        self.context.removeJobTag(self.tag)
        if error is not None and not isinstance(error, (Cancelled, TimedOut)):
            self.check(self.stage)

    def _stop(self, why: str) -> None:
        self.why = self.why or why
        self.context.cancelJobsWithTag(self.tag)

    def cancel(self) -> None:
        self._stop("cancelled")

    def check(self, stage: str) -> None:
        self.stage = stage
        if self.why == "cancelled":
            raise Cancelled(f"cancelled at {stage}")
        if self.why == "timeout" or (self.seconds is not None and self.elapsed() >= self.seconds):
            raise TimedOut(f"more than {self.seconds:g} s at {stage}")

    def elapsed(self) -> float:
        return round(time.monotonic() - self.started, 3)
