"""A stream of job events: changes, late and repeated events, deadlines, forgetting; the same of a table."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexweave.streaming import status as W
from lexweave.streaming import tracker as K

T0 = datetime(2024, 1, 1)


def event(job, minute, stage, status="running", progress=0.5):
    return job, stage, status, progress, T0 + timedelta(minutes=minute)


BATCHES = [
    [event("a", 0, "extracting", progress=0.05), event("b", 0, "extracting", progress=0.05), event("c", 1, "queued", progress=0.0), (None, "x", "running", 0.1, T0)],
    [event("a", 2, "translating", progress=0.3), event("a", 1, "detecting_language", progress=0.15)],
    [event("a", 5, "done", "completed", 1.0), event("a", 5, "done", "completed", 1.0)],
    [event("d", 20, "queued", progress=0.0), event("a", 18, "translating", progress=0.3)],  # a has ended: no change
    [event("b", 90, "done", "completed", 1.0), event("d", 61, "exporting", progress=0.9)],  # b ends after its deadline
    [event("z", 200, "queued", progress=0.0)],  # the watermark passes the deadlines of b, c and d
    [event("e", 201, "queued", progress=0.0), event("z", 202, "exporting", progress=0.9)],
    [event("z", 203, "done", "completed_with_warnings", 1.0)],
]


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(name)
    spark.conf.set(name, K.ROCKSDB)
    yield spark
    spark.conf.set(name, own)


def test_jobs_of_a_stream(rocksdb, tmp_path):
    spark = rocksdb
    out, changes = [], {}
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, W.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events/batch={i}")
        stream = spark.readStream.schema(W.EVENTS).parquet(f"{tmp_path}/events/batch=*")
        query = K.tracked(stream, timedelta(minutes=60), timedelta(minutes=30), "1 minute")
        done = query.writeStream.option("checkpointLocation", f"{tmp_path}/c").outputMode("update").trigger(availableNow=True).foreachBatch(lambda df, n: out.extend(df.collect())).start()
        assert done.awaitTermination(120)
    for r in out:
        changes.setdefault(r["job_id"], []).append((r["stage"], r["status"], r["code"], r["seconds"]))
    assert changes["a"] == [("extracting", "running", None, 0.0), ("translating", "running", None, 120.0), ("done", "completed", None, 300.0)]
    assert changes["b"][-1] == ("extracting", "failed", "TIMED_OUT", 3600.0) and len(changes["b"]) == 2
    assert changes["c"][-1][1:3] == ("failed", "TIMED_OUT") and changes["d"][-1] == ("exporting", "failed", "TIMED_OUT", 3600.0)
    assert changes["e"] == [("queued", "running", None, 0.0)] and changes["z"][-1] == ("done", "completed_with_warnings", None, 180.0) and None not in changes
    # Jobs that ended long ago are forgotten: only those of the last deadline and keeping time are in the state.
    state = spark.read.format("statestore").option("stateVarName", "job").load(f"{tmp_path}/c")
    assert {"e", "z"} <= {r["k"] for r in state.select(F.col("key.job_id").alias("k")).collect()}
    assert "a" not in {r["k"] for r in state.select(F.col("key.job_id").alias("k")).collect()}
    # A table of all events says the same.
    table = K.settled(spark.createDataFrame([r for b in BATCHES for r in b], W.EVENTS), timedelta(minutes=60), T0 + timedelta(minutes=203))
    assert {r["job_id"]: (r["stage"], r["status"], r["code"], r["seconds"]) for r in table.collect()} == {j: c[-1] for j, c in changes.items()}
