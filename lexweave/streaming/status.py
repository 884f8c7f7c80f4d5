"""Job events as a stream: each job's latest status, terminal events, and an idempotent sink for translated chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexweave.operators.jobs import STATUSES, latest_status

# How far a job is when it enters a stage; translation and reconciliation have two steps each in thorough jobs.
PROGRESS = {"queued": 0.0, "extracting": 0.05, "detecting_language": 0.15, "translating": 0.3, "second_pass": 0.5, "translated": 0.65, "reconciling": 0.7, "exporting": 0.9, "completed": 1.0}
EVENTS = "job_id string, stage string, status string, progress double, updated_at timestamp"


def stage_event(job_ids: DataFrame, step: str) -> DataFrame:
    """Events of jobs (job_id) that enter a step, for the events' table."""
    return job_ids.select("job_id", F.lit(step).alias("stage"), F.lit("running").alias("status"), F.lit(PROGRESS[step]).alias("progress"), F.current_timestamp().alias("updated_at"))


def latest(events: DataFrame) -> DataFrame:
    """The same of a stream as of a table: one row per job, in update or complete mode; its state grows with the open jobs."""
    return latest_status(events)


def terminal(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The events that end a job, once each, also where a producer repeats them within ``late``."""
    done = events.where(F.col("status").isin(*STATUSES))
    return done.withWatermark("updated_at", late).dropDuplicatesWithinWatermark(["job_id", "status"]) if events.isStreaming else done.dropDuplicates(["job_id", "status"])


def each_terminal(events: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``deliver`` with the terminal events of every batch, such as a webhook's sender."""
    return terminal(events).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(deliver).start()


def append_memo(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds translated chunks to the memo's Parquet folder; a batch that is run again overwrites its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return chunks.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
