"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, packing; see run()."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import lines, mixing, nearcopies, packing, toxicity
from lexweave.llm.common import bound_batches, materialize, table


def bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with batches to Python bounded by bytes: an executor's memory holds the workers and buffers of all stages of a session."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic, with their columns.

    Null text is empty text and scored; rows with null or repeated ids are scored each; equal texts are decided alike; long texts are read
    whole; without toxic labels none is predicted; an empty table stays empty.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


@bounded
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines and sentences that recur in other texts.

    Null and empty texts stay; ids are not read; equal texts are cut alike; the text with the smallest digest keeps a passage;
    n_chars stays as it was; an empty table stays empty.
    """
    return lines.drop_recurring(docs)


@bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id, then text digest.

    Links are those of op3's fingerprints (4 bits or fewer) at a five-word similarity of 0.8 or more, repeats counted, and those of texts whose
    different runs of five words have that similarity.

    Null and empty texts are one group; rows without an id take part after all others; rows that repeat an id are told apart by their
    texts, and rows that repeat both are one; long texts are compared whole; an empty table stays empty.
    """
    return nearcopies.one_of_each_group(docs)


@bounded
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents, whole, as often as it takes them; the one in which a source's quota ends if half of it or more is taken.

    Documents without words (null or empty text) are never taken; the null source is a source; rows that repeat an id are documents of
    their own, in one place of the order; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


@bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids in sequences of 1024.

    Null text is the closing id alone; every row, also one that repeats another, is packed; long texts are cut into pieces; an empty
    table has no sequences.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]
ORACLE_SQL = None  # tokens, a trained model and templates are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on the whole documents table, each written to the shared folder and read again by the next.

    All but the last return the columns of documents, whatever these are; what a stage does with odd rows is said at the stage.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
