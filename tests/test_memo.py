"""The bucketed memo: lookups that do not move it, batches that are run again, compaction."""

import re

import pytest
from pyspark.sql import functions as F

from lexweave.operators import translate as TR
from lexweave.operators.completion import counted
from lexweave.plans import service
from lexweave.sinks.memo import Memo, memo

ROW = "doc_id long, chunk_index int, pass_num int, llm string, source_hash string, text string"


@pytest.fixture
def held(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS memo_test")
    yield memo(spark, "memo_test", f"file://{tmp_path}/memo", "doc_id long", 8)
    spark.sql("DROP TABLE IF EXISTS memo_test")


def row(i, text="t", h="h", chunk=0):
    return (i, chunk, 1, "mock", h, text)


def read(spark, m):
    return sorted(map(tuple, m.rows(spark).collect()), key=str)


def test_batches(spark, held):
    rows = lambda *r: spark.createDataFrame(list(r), ROW)
    assert read(spark, held) == [] and held.batches(spark) == []
    held.append(rows(row(1), row(1, "s"), row(2), row(3, None), row(None)).selectExpr("*", "1 AS batch", "2 AS other"), "a")
    assert read(spark, held) == sorted([row(1, "s"), row(2), row(None)], key=str)  # repeated names once, no null text
    held.append(rows(row(2, "other"), row(4)), "b")
    assert row(2) in read(spark, held) and row(4) in read(spark, held) and row(2, "other") not in read(spark, held)
    held.append(rows(row(1), row(5)), "b")  # run again with other rows: the batch is replaced
    assert [r[0] for r in read(spark, held)] == [1, 2, 5, None] and held.batches(spark) == ["a", "b"]
    for bad in ("x'y", "", "compacted-9"):
        with pytest.raises(ValueError, match="batch"):
            held.append(rows(row(1)), bad)


def test_compaction(spark, held, tmp_path):
    for n in range(3):
        held.append(spark.createDataFrame([row(i, f"t{i}", chunk=n) for i in range(40)], ROW), f"run-{n}")
    want = read(spark, held)
    files = lambda: list((tmp_path / "memo").rglob("part-*.parquet"))
    assert len(want) == 120 and len(files()) > 8
    held.compact(spark)
    assert held.batches(spark) == ["compacted-0"] and read(spark, held) == want and len(files()) <= 8
    held.compact(spark)
    held.append(spark.createDataFrame([row(99)], ROW), "late")
    held.compact(spark)
    assert held.batches(spark) == ["compacted-1"] and len(read(spark, held)) == 121
    # A compaction that died before its drops leaves rows twice; the next one has them once.
    held._write(held.rows(spark), "compacted-2")
    assert len(read(spark, held)) == 242
    held.compact(spark)
    assert len(read(spark, held)) == 121
    # Another session's catalogue takes the batches up.
    spark.sql("DROP TABLE memo_test")
    again = memo(spark, "memo_test", f"file://{tmp_path}/memo", "doc_id long", 99)
    assert again == Memo("memo_test", f"file://{tmp_path}/memo/buckets-8", ("doc_id",), 8)  # the number of buckets is the folder's
    assert len(read(spark, again)) == 121


def exchanges_above_memo(plan):
    """Exchanges between the scan of the memo and the joins that read it, of a plan as text."""
    lines, out = plan.split("\n"), []
    depth = lambda line: len(re.match(r"[ :+|-]*", line).group())
    for at, line in enumerate(lines):
        if "memo_test" not in line or "Scan" not in line:
            continue
        deep = depth(line)
        for above in reversed(lines[:at]):
            if depth(above) < deep:
                deep = depth(above)
                if "Join" in above:
                    break
                if "Exchange" in above:
                    out.append(above)
    return out


def test_lookups_leave_the_memo_where_it_is(spark, held):
    held.append(spark.createDataFrame([row(i) for i in range(50)], ROW), "a")
    chunks = spark.createDataFrame([row(i) for i in range(100)], ROW).selectExpr("*", "'' AS heading_context", "'de' AS source_lang", "'en' AS target_lang", "false AS is_legal", "'' AS summary", "'' AS context")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df, scans in ((TR.pending(chunks, held.rows(spark), ["doc_id"]), 1), (TR.attempt_chunks(chunks, counted(lambda s, u: u), held.rows(spark), ["doc_id"]), 2)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Scan parquet spark_catalog.default.memo_test") >= scans and exchanges_above_memo(plan) == []
            assert len(df.collect()) == (50 if scans == 1 else 100)
        moved = TR.pending(chunks, held.rows(spark).repartition(3), ["doc_id"])  # the same of a table that is not bucketed
        assert exchanges_above_memo(moved._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_second_run_asks_nothing(spark, held, tmp_path):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/checkpoints")
    docs = spark.createDataFrame([(i, f"# Titel {i}\n\nDer Hund und die Katze sind nicht in dem Haus, das wir mit der Familie {i} haben.") for i in range(6)], "doc_id long, text string")
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def reply(system, user):
        asked.add(int(system.startswith("You are a professional translator")))
        return "The dog."

    first = service.run(docs, reply, memo=held.rows(spark))
    held.append(first.memo, "first")
    assert first.outputs.where("status <> 'failed'").count() == 6 and held.rows(spark).count() >= 6
    n = asked.value
    assert n > 0
    second = service.run(docs, reply, memo=held.rows(spark))
    assert second.outputs.count() == 6 and asked.value == n
    docs = docs.selectExpr("doc_id", "IF(doc_id = 3, concat(text, ' Neu.'), text) AS text")
    service.run(docs, reply, memo=held.rows(spark)).outputs.count()
    assert asked.value == n + 1  # another text is another chunk
