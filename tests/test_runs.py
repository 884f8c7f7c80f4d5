import pytest
from pyspark.sql import functions as F

from lexweave.operators import runs as N


def test_job_ids(spark):
    inputs = spark.createDataFrame([(0, "a"), (1, "b")], "pos long, path string")
    assert {r["path"]: r["job_id"] for r in N.with_job_ids(inputs, ["x", "y"]).collect()} == {"a": "x", "b": "y"}
    assert all(len(r["job_id"]) == 36 for r in N.with_job_ids(inputs).collect())
    for bad in (["x"], ["x", "x"], ["x", "no/id"]):
        with pytest.raises(ValueError):
            N.with_job_ids(inputs, bad)


def test_run_rules(spark):
    rows = spark.createDataFrame([(True, False, False, False), (True, False, True, False), (False, False, False, True), (True, True, False, True), (True, True, True, True)], "e boolean, c boolean, f boolean, r boolean")
    got = [r[0] for r in rows.coalesce(1).select(N.start_error(*[F.col(c) for c in "ecfr"])).collect()]
    assert got == ["the job exists", None, "nothing to resume", None, "force and resume exclude each other"]
    files = spark.createDataFrame([("j", k, f"/{k}") for k in ("extracted", "memo", "markdown")], "job_id string, kind string, path string")
    kinds = lambda **k: sorted(r["kind"] for r in N.to_remove(files, **k).collect())
    assert kinds() == ["extracted", "memo"] and kinds(keep_checkpoints=True) == ["extracted"] and kinds(keep_checkpoints=True, keep_intermediate=True) == []
    t = lambda s: F.lit(s).cast("timestamp")
    row = spark.range(1).select(N.elapsed(t("2024-01-01 00:00:00"), t("2024-01-01 00:00:01.2344")), N.elapsed(t("2024-01-02"), t("2024-01-01")), N.cover_date(t("2024-01-01 05:06:07"))).first()
    assert tuple(row) == (1.234, 0.0, "2024-01-01 05:06 UTC")


def test_usage_and_notices(spark):
    calls = spark.createDataFrame([("s", 0, 1, 5, -3), ("s", 1, 1, 7, 2), ("t", 0, 2, None, 1)], "batch string, pos int, calls long, tokens_in long, tokens_out long")
    assert sorted(tuple(r) for r in N.running_usage(calls).collect()) == [("s", 0, 1, 5, 0), ("s", 1, 2, 12, 2), ("t", 0, 2, 0, 1)]
    jobs = spark.createDataFrame([("a", "completed"), ("b", "failed"), ("c", "completed")], "job_id string, status string")
    sent = spark.createDataFrame([("a", False, "down"), ("b", False, "down"), ("c", True, None)], "job_id string, delivered boolean, error string")
    after, issues = N.after_notices(jobs, sent)
    assert {r["job_id"]: r["status"] for r in after.collect()} == {"a": "completed_with_warnings", "b": "failed", "c": "completed"}
    assert sorted(r["job_id"] for r in issues.collect()) == ["a", "b"] and issues.first()["severity"] == "warn"


def test_running_totals_in_blocks(spark):
    import random

    rng = random.Random(2)
    rows = [(b, p, 1, rng.randrange(-5, 9), rng.choice([None, 3])) for b in ("x", "y", None) for p in rng.sample(range(-20, 400), 60)]
    calls = spark.createDataFrame(rows, "batch string, pos long, calls long, tokens_in long, tokens_out long")
    want, so_far = {}, {}
    for b, p, c, i, o in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        have = so_far.get(b, (0, 0, 0))
        want[b, p] = so_far[b] = (have[0] + c, have[1] + max(0, i), have[2] + max(0, o or 0))
    for block in (1, 7, 1 << 16):
        got = {(r["batch"], r["pos"]): (r["calls"], r["tokens_in"], r["tokens_out"]) for r in N.running_usage(calls, block).collect()}
        assert got == want
    assert N.running_usage(calls.limit(0)).collect() == []
