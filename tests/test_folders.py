"""Job folders: files of a run appear together or not at all."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lexweave.sinks import folders as S


@pytest.fixture
def at(spark, tmp_path):
    S.register(spark)
    return f"file://{tmp_path}/jobs"


def written(df, at, run=None):
    w = df.write.format("job_folders").mode("append").option("path", at)
    (w.option("run", run) if run else w).save()


def found(spark, at, **options):
    rows = spark.read.format("job_folders").options(path=at, **options).load().collect()
    assert len(rows) == len({(r["job_id"], r["name"]) for r in rows})
    return {(r["job_id"], r["name"]): bytes(r["content"]).decode() for r in rows}


def all_files(at):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(at.removeprefix("file://")) for f in names)


def jobs(spark, n, text="t"):
    return spark.range(n).select(F.concat(F.lit("j"), "id").alias("job_id"), F.lit("a.md").alias("name"), F.concat(F.lit(text), "id").cast("binary").alias("content")).repartition(3)


def test_a_run_is_one_transaction(spark, at):
    assert found(spark, at) == {}
    written(jobs(spark, 20), at, "one")
    want = {(f"j{i}", "a.md"): f"t{i}" for i in range(20)}
    assert found(spark, at) == want and S.manifest_of(at, "one")["files"] == 20
    files = len(all_files(at))
    written(jobs(spark, 20), at, "one")  # a rerun equals one run
    assert found(spark, at) == want and len(all_files(at)) == files
    # A write that fails leaves nothing, neither of a new run nor of one that was there.
    bad = jobs(spark, 20, "new").withColumn("name", F.when(F.col("job_id") == "j13", "../x").otherwise(F.col("name")))
    for run in ("one", "two"):
        with pytest.raises(Exception, match="plain"):
            written(bad, at, run)
        assert found(spark, at) == want and len(all_files(at)) == files
    written(jobs(spark, 3, "u").withColumn("job_id", F.concat(F.lit("k"), "job_id")), at)
    assert found(spark, at, run="one") == want and found(spark, at) == want | {(f"kj{i}", "a.md"): f"u{i}" for i in range(3)}


def test_files_of_other_attempts_do_not_count(spark, at):
    left = f"{at.removeprefix('file://')}/data/one/00000-9-dead/j1"
    os.makedirs(left)
    open(f"{left}/a.md", "w").close()
    written(jobs(spark, 5), at, "one")
    assert found(spark, at) == {(f"j{i}", "a.md"): f"t{i}" for i in range(5)} and not os.path.exists(left)
    written(jobs(spark, 0), at, "none")
    assert S.manifest_of(at, "none") == {"run": "none", "attempts": [], "files": 0, "bytes": 0}
    with pytest.raises(Exception, match="run"):
        written(jobs(spark, 1), at, "../up")


def test_files_of_jobs(spark, at):
    rows = [("dir/ä.txt", "completed", "x\n", "# x\n"), ("7", "failed", None, None), (None, "failed", None, None)]
    outputs = spark.createDataFrame(rows, "doc_id string, status string, text string, markdown string")
    written(S.files_of(outputs), at, "r")
    got = found(spark, at)
    assert {n for j, n in got if j == "7"} == {"status.json"} and json.loads(got["7", "status.json"]) == {"doc_id": "7", "status": "failed"}
    odd = next(j for j, n in got if n == "translated.md")
    assert odd.startswith("dir___txt-") and S.JOB_ID.fullmatch(odd) and got[odd, "translated.md"] == "# x\n" and len(got) == 3


def test_a_task_that_outlives_the_abort_leaves_nothing(tmp_path, monkeypatch):
    """Spark aborts a write while killed tasks still run; what these go on to write must not appear."""

    class Task:
        partitionId, taskAttemptId = staticmethod(lambda: 0), staticmethod(lambda: 7)

    monkeypatch.setattr(S, "TaskContext", type("Context", (), {"get": staticmethod(Task)}))
    at = f"file://{tmp_path}/jobs"
    row = lambda i: {"job_id": f"j{i}", "name": "a.md", "content": f"t{i}"}
    first = S.FolderWriter(at, "one")
    first.commit([first.write(iter([row(0)])), None])
    before = all_files(at)
    late = S.FolderWriter(at, "one")

    def rows():
        yield row(1)
        late.abort([])
        yield row(2)

    for task in (rows(), iter([row(3)])):  # one that had begun, one that begins afterwards
        with pytest.raises(OSError):
            late.write(task)
        assert all_files(at) == before
    assert S.manifest_of(at, "one")["files"] == 1
