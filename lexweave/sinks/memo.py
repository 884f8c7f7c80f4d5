"""The memo of translated chunks as a bucketed table: looking chunks up moves the chunks alone, and batches are added, run again and compacted.

The table is bucketed by all columns that name a row (the document's keys, chunk_index, pass_num, llm, source_hash), so neither the
anti-join that finds new chunks nor the join that fetches known ones shuffles it; what moves is a run's chunks, to as many partitions as
there are buckets.  A batch is a partition of the table: writing it again replaces it, and a writer that dies leaves the others as they were;
its own batch is asked for again.
``compact`` writes the rows of all batches once more, each once, as one file a bucket, and drops the batches only when that is done; between
the two steps rows are there twice, which lookups do not mind.

Defined results: an empty memo has no rows; rows that repeat a name are one, with the least text, also across batches; a row with a null in
its name is kept but never found, as null equals nothing in a join; null texts are no translations and are not added; other columns of the
rows are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.translate import MEMO

BUCKETS = 256
COMPACTED = "compacted"


@dataclass(frozen=True)
class Memo:
    """A memo's table in its folder; ``keys`` name documents."""

    name: str
    folder: str
    keys: tuple[str, ...]
    buckets: int

    @property
    def named(self) -> list[str]:
        return [*self.keys, "chunk_index", *MEMO]

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows of all batches, for service.run or translate_chunks as their memo."""
        return spark.table(self.name).select(*self.named, "text")

    def append(self, rows: DataFrame, batch: str) -> None:
        """Adds rows that the memo lacks as a batch, in place of an earlier one of that name.

        They go to tasks by bucket, so a batch is one file a bucket at most.
        """
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch) or batch.startswith(COMPACTED):
            raise ValueError(f"not a batch's name: {batch!r}")
        spark = rows.sparkSession
        if batch in self.batches(spark):
            self._drop(spark, batch)
        have = spark.table(self.name).select(*self.named)
        self._write(rows.where("text IS NOT NULL").join(have, self.named, "left_anti"), batch)

    def batches(self, spark: SparkSession) -> list[str]:
        return sorted(r[0].removeprefix("batch=") for r in spark.sql(f"SHOW PARTITIONS {self.name}").collect())

    def compact(self, spark: SparkSession, least: int = 2) -> None:
        """One batch of all, each row once, if there are ``least`` batches; those that it replaces are dropped afterwards."""
        old = self.batches(spark)
        if len(old) < max(2, least):
            return
        numbers = [int(b.removeprefix(f"{COMPACTED}-")) for b in old if b.startswith(COMPACTED)]
        self._write(spark.table(self.name).where(F.col("batch").isin(old)), f"{COMPACTED}-{max(numbers, default=-1) + 1}")
        for b in old:
            self._drop(spark, b)

    def _drop(self, spark: SparkSession, batch: str) -> None:
        spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch = '{batch}')")
        files, path = _files(spark, f"{self.folder}/batch={batch}")  # a table at a given location keeps its files
        files.delete(path, True)

    def _write(self, rows: DataFrame, batch: str) -> None:
        once = rows.select(*self.named, "text").groupBy(*self.named).agg(F.min("text").alias("text"))
        dealt = once.repartition(self.buckets, *self.named)
        columns = ", ".join([*self.named, "text"])
        rows.sparkSession.sql(f"INSERT INTO TABLE {self.name} PARTITION (batch = '{batch}') SELECT {columns} FROM {{dealt}}", dealt=dealt)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def memo(spark: SparkSession, name: str, location: str, keys: str = "doc_id string", buckets: int = BUCKETS) -> Memo:
    """The memo at a location that all machines share, made if it is not there; ``keys`` is a schema, such as "doc_id long".

    The number of buckets is fixed when the memo is made and is the name of its folder: take the tasks that one run's chunks need, some
    100 MB of texts each.  A later number is not regarded.  A session whose catalogue does not know the table takes the folder's batches up.
    """
    names = tuple(re.findall(r"(\w+)\s+\w+", keys))
    named = ", ".join([*names, "chunk_index", *MEMO])
    columns = f"{keys}, chunk_index int, pass_num int, llm string, source_hash string, text string, batch string"
    files, made = _files(spark, location.rstrip("/") + "/buckets-*")
    there = files.globStatus(made) or []
    buckets = int(there[0].getPath().getName().removeprefix("buckets-")) if len(there) else buckets
    place = location.rstrip("/") + f"/buckets-{buckets}"
    files.mkdirs(_files(spark, place)[1])
    known = spark.catalog.tableExists(name)
    quoted = place.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({named}) INTO {buckets} BUCKETS LOCATION '{quoted}'")
    if not known:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return Memo(name, place, names, buckets)
