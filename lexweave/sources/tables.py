"""Tables and text files as DataFrames."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import normalize

MAX_BYTES = 20_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def glob_of(suffixes: set[str]) -> str:
    """A path filter for suffixes in any case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in sorted(suffixes)) + "}"


def text_files(spark: SparkSession, path: str, pattern: str = "*.{[tT][xX][tT],[mM][dD],[mM][aA][rR][kK][dD][oO][wW][nN]}") -> DataFrame:
    """path, bytes, text (normalised), encoding_loss, too_large of text and Markdown files.

    Broken UTF-8 is replaced and flagged; files over MAX_BYTES are listed without being read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    large = F.col("length") > MAX_BYTES
    decode = F.pandas_udf(lambda c: c.map(lambda b: bytes(b).decode("utf-8", "replace")), "string")
    small = files.where(~large).select("path", F.col("length").alias("bytes"), decode("content").alias("raw"))
    small = small.select("path", "bytes", normalize(F.col("raw")).alias("text"), F.contains("raw", F.lit("\ufffd")).alias("encoding_loss"), F.lit(False).alias("too_large"))
    rest = files.where(large).select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("encoding_loss"), F.lit(True).alias("too_large"))
    return small.unionByName(rest)


# Named character references that are decoded; numeric ones are left to the parser of whole documents.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def html_text(html):
    """Markdown of HTML: scripts, styles, comments and the head gone, headings, links, emphasis and list items marked, tags removed."""
    h = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head|template)\b[^>]*>.*?</(script|style|head|template)>", "")
    for level in range(1, 7):
        h = F.regexp_replace(h, rf"(?i)<h{level}\b[^>]*>", "\n\n" + "#" * level + " ")
    h = F.regexp_replace(h, r'(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)")
    h = F.regexp_replace(h, r"(?i)</?(b|strong)\b[^>]*>", "**")
    h = F.regexp_replace(h, r"(?i)</?(i|em)\b[^>]*>", "*")
    h = F.regexp_replace(h, r"(?i)<li\b[^>]*>", "\n- ")
    h = F.regexp_replace(h, r"(?i)<br\s*/?>", "\n")
    h = F.regexp_replace(h, r"(?i)</?(p|div|ul|ol|h[1-6]|article|section|nav|footer|table|tr)\b[^>]*>", "\n\n")
    h = F.regexp_replace(h, r"(?s)<[^>]*>", "")
    for entity, char in ENTITIES.items():
        h = F.replace(h, F.lit(entity), F.lit(char))
    h = F.regexp_replace(h, r"\n{3,}", "\n\n")
    return F.regexp_replace(h, r"^\s+|\s+$", "")
