"""The document source: what it opens for a condition, and that rows are right in Spark."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from lexweave.sources import documents as D

NAME = "spark.sql.python.filterPushdown.enabled"


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "docs"
    (at / "sub").mkdir(parents=True)
    (at / "a.TXT").write_text("one\ftwo\fthree")
    (at / "b.md").write_text("# b")
    (at / "sub" / "c.pdf").write_bytes(b"%PDF\f" + b"x" * 500)
    (at / "sub" / "d.txt").write_text("")
    (at / "none").write_text("n")
    (at / "_skipped.txt").write_text("no")
    return f"file://{at}"


def opened(folder, *filters, **options):
    """Names of opened files, the rows, and the conditions that the source does not take."""
    reader = D.DocumentReader({"path": folder, **options})
    rest = list(reader.pushFilters(list(filters)))
    seen, real = [], reader._open
    reader._open = lambda store, path: seen.append(path.rsplit("/", 1)[1]) or real(store, path)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    return sorted(seen), rows, rest


def test_only_wanted_files_are_opened(folder):
    assert opened(folder)[0] == ["a.TXT", "b.md", "c.pdf", "d.txt", "none"] and len(opened(folder)[1]) == 7
    assert opened(folder, EqualTo(("suffix",), "txt"))[0] == ["a.TXT", "d.txt"]
    assert opened(folder, In(("suffix",), ("md", "pdf")), GreaterThan(("bytes",), 100))[0] == ["c.pdf"]
    assert opened(folder, LessThanOrEqual(("bytes",), 3), IsNotNull(("bytes",)))[::2] == (["b.md", "d.txt", "none"], [])
    seen, rows, rest = opened(folder, GreaterThan(("page",), 1), StringContains(("path",), "a"))
    assert seen == ["a.TXT", "b.md", "d.txt"] and [(r[3], r[4], r[5]) for r in rows] == [(2, 3, b"two"), (3, 3, b"three")] and [type(f) for f in rest] == [StringContains]
    assert opened(folder, StringEndsWith(("path",), ".pdf"))[0] == ["c.pdf"] and opened(folder, StringStartsWith(("suffix",), "t"))[0] == ["a.TXT", "d.txt"]
    seen, rows, _ = opened(folder, EqualTo(("suffix",), "txt"), content="false")
    assert seen == [] and [(r[2], r[4], r[5]) for r in rows] == [(13, None, None), (0, None, None)]
    assert opened(folder, LessThanOrEqual(("page",), 0))[1] == [] and opened(folder, EqualTo(("bytes",), None))[2] != []


def test_partitions_by_bytes(folder):
    sizes = lambda n: [sum(s for _, s in p.files) for p in D.DocumentReader({"path": folder, "taskbytes": str(n)}).partitions()]
    assert sizes(1 << 20) == [13 + 3 + 1 + 505] and sizes(20) == [17, 505] and sizes(1) == [13, 3, 1, 505]


def test_rows_in_spark(spark, folder, tmp_path):
    D.register(spark)
    own = spark.conf.get(NAME)
    spark.conf.set(NAME, "true")
    try:
        load = lambda: spark.read.format("document_files").option("path", folder).option("taskBytes", 20).load()
        wanted = load().where("suffix IN ('txt', 'md') AND bytes > 2 AND page >= 2 AND path LIKE '%a.TXT'")
        assert [(r["page"], bytes(r["content"]), r["error"]) for r in wanted.orderBy("page").collect()] == [(2, b"two", None), (3, b"three", None)]
        plan = wanted._jdf.queryExecution().executedPlan().toString()
        above = [line for line in plan.split("\n") if line.lstrip(" +-*()0123456789").startswith("Filter")]
        assert above == [], plan
        assert load().where(F.col("suffix") == "zip").collect() == [] and load().count() == 7
        assert spark.read.format("document_files").option("path", f"file://{tmp_path}/nothing").load().collect() == []
    finally:
        spark.conf.set(NAME, own)
