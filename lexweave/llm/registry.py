"""The queries of this subpackage, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import alignment, bpe, divergence, forest, licenses, lines, media, mixing, oracles, packing, quality, simhash, toxicity, warc
from lexweave.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as JPEG, read back."""
    return media.features(media.store(table(spark, sf_dir, "documents")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines whose templates recur."""
    return lines.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op5_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every twentieth."""
    return forest.nearest(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document, and the shards to which the tree dealt its copies."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence phrases and labels of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perplexity of every document, and whether it is kept."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written to archives and read back."""
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages")).drop("intact")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids and the text that they give again, as digests."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every source's words are from those of the language's other sources, and the words that set it apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers lie on every document."""
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_media": op2_media,
    "op3_simhash": op3_simhash,
    "op4_lines": op4_lines,
    "op5_forest": op5_forest,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_licenses": op8_licenses,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_bpe": op11_bpe,
    "op12_divergence": op12_divergence,
    "op13_alignment": op13_alignment,
}
ORACLES: dict[str, str] = oracles.ORACLES
