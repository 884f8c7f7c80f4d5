"""What the operators share: the folder that all machines see, written intermediate tables, table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words in the contracts: space and the controls tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on batches of rows go to Python at BATCH_BYTES (Spark: 64 MB), unless the session's owner has set another size.

    Results are read after the operator has returned, so this stays set.  A batch is in memory several times: in Spark's buffer, the
    worker's, and its strings.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one where it is unset, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="lexweave-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The application's own folder for written intermediate tables; results read them, so their owner drops it after the last use."""
    return f"{shared_dir(spark)}/lexweave/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what the operators of this application have written; DataFrames that they returned cannot be read any more."""
    jvm, path = spark.sparkContext._jvm, scratch_root(spark)
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a table written to the shared folder, so that a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
