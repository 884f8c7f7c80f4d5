"""Jobs as a run sees them: their ids, what may start, running totals, what a failed notice changes, what is kept of their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.rules import job_id_ok
from lexweave.operators.jobs import STATUSES

# What a run may leave behind, by the option that keeps it.
WORKING = {"keep_intermediate": ["extracted", "chunks", "passes"], "keep_checkpoints": ["memo", "checkpoint"]}


def with_job_ids(inputs: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Inputs (pos from 0, path) with job_id: the given one at that place, else a random one; write the result once, as the latter change.

    Too few or too many ids, repeated or malformed ones are an error of the caller.
    """
    if ids is None:
        return inputs.withColumn("job_id", F.uuid())
    if len(set(ids)) != len(ids):
        raise ValueError("a job id is given twice")
    if inputs.count() != len(ids):
        raise ValueError("inputs and job ids differ in number")
    named = inputs.sparkSession.createDataFrame(list(enumerate(ids)), "pos long, job_id string")
    if not named.where(~job_id_ok(F.col("job_id"))).isEmpty():
        raise ValueError("a job id is malformed")
    return inputs.join(named, "pos")


def start_error(exists: Column, has_checkpoint: Column, force: Column, resume: Column) -> Column:
    """Why a job cannot start in its folder, or null: it is there and neither replaced nor resumed, or there is nothing to resume."""
    out = F.when(force & resume, "force and resume exclude each other")
    return out.when(resume & ~has_checkpoint, "nothing to resume").when(exists & ~force & ~resume, "the job exists")


def running_usage(calls: DataFrame, block: int = 1 << 16) -> DataFrame:
    """batch, pos, calls, tokens_in, tokens_out of jobs (batch, pos and the same), each with what the jobs before it in its batch used.

    Negative counts are none.  Places are cut into blocks of ``block``: a window adds up within each, another over the blocks' totals, so that no
    task holds a batch, however long.  Rows of equal pos are added in any order; those without a pos come first.
    """
    names = ["calls", "tokens_in", "tokens_out"]
    rows = calls.select("batch", "pos", F.coalesce(F.floor(F.col("pos") / block), F.lit(-(1 << 62))).alias("__block"), *[F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c) for c in names])
    totals = rows.groupBy("batch", "__block").agg(*[F.sum(c).alias(f"__{c}") for c in names])
    before = Window.partitionBy("batch").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(F.col("batch").alias("__batch"), F.col("__block").alias("__of"), *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in names])
    within = Window.partitionBy("batch", "__block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.join(ahead, F.col("batch").eqNullSafe(F.col("__batch")) & (F.col("__block") == F.col("__of")))
    return met.select("batch", "pos", *[(F.sum(c).over(within) + F.col(f"__{c}")).alias(c) for c in names])


def after_notices(jobs: DataFrame, delivered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs (job_id, status) with the status that undelivered notices (job_id, delivered, error) leave, and the issues for these.

    A failed notice is a warning: a completed job then has warnings, a failed one stays so.
    """
    missed = delivered.where(~F.col("delivered")).groupBy("job_id").agg(F.min("error").alias("notice_error"))
    out = jobs.join(missed, "job_id", "left")
    status = F.when(F.col("notice_error").isNotNull() & (F.col("status") == STATUSES[0]), STATUSES[1]).otherwise(F.col("status"))
    issues = missed.select("job_id", F.lit("WEBHOOK_FAILED").alias("code"), F.lit("warn").alias("severity"), F.col("notice_error").alias("message"), F.lit("completed").alias("stage"), F.lit(1000).cast("long").alias("pos"))
    return out.withColumn("status", status).drop("notice_error"), issues


def to_remove(files: DataFrame, **keep: bool) -> DataFrame:
    """The working files (job_id, kind, path) of ended jobs that no option keeps; ``keep`` has the names of WORKING."""
    gone = [kind for option, kinds in WORKING.items() if not keep.get(option, False) for kind in kinds]
    return files.where(F.col("kind").isin(gone)) if gone else files.limit(0)


def elapsed(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, three digits, not below 0."""
    return F.round(F.greatest(F.lit(0.0), (F.unix_micros(end) - F.unix_micros(start)) / 1e6), 3)


def cover_date(at: Column) -> Column:
    """A cover's date; the session's time zone has to be UTC."""
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))
