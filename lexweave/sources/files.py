"""All supported files of a folder as one table of texts: each suffix goes to its reader, what has none gets an error row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.formats import IMAGE_SUFFIXES, export_format, rtf_text, suffix, supported, without_front_matter
from lexweave.functions.text import normalize
from lexweave.sources.office import office_files
from lexweave.sources.tables import MAX_BYTES, glob_of, html_text, text_files

#: Suffixes with a reader here; the others of the format table need programs outside Spark, for which ``extra`` is the place.
TEXT = {"txt", "md", "markdown"}
MARKUP = {"html", "htm", "rtf"}
OFFICE = {"docx", "odt", "epub"}


def inputs(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """path, bytes, suffix, format, error of every file under a folder, without reading any; error: unsupported, too large or null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    error = F.when(~F.coalesce(supported(F.col("path")), F.lit(False)), "unsupported").when(F.col("bytes") > most, "too large")
    return files.select("path", "bytes", suffix(F.col("path")).alias("suffix"), export_format(F.col("path")).alias("format"), error.alias("error"))


def extract(spark: SparkSession, path: str, extra: dict[str, object] | None = None) -> DataFrame:
    """path, bytes, format, text, encoding_loss, error.

    ``extra`` maps suffixes, such as pdf or png, to functions from a DataFrame (path, bytes) to one (path, text, error).
    """
    extra = extra or {}
    listed = inputs(spark, path)
    text = text_files(spark, path, glob_of(TEXT)).select("path", without_front_matter(F.col("text")).alias("text"), "encoding_loss", F.lit(None).cast("string").alias("why"))
    markup = text_files(spark, path, glob_of(MARKUP)).select("path", F.when(suffix(F.col("path")) == "rtf", normalize(rtf_text(F.col("text")))).otherwise(normalize(html_text(F.col("text")))).alias("text"), "encoding_loss", F.lit(None).cast("string").alias("why"))
    office = office_files(spark, path).select("path", normalize(F.col("text")).alias("text"), F.lit(False).alias("encoding_loss"), F.col("error").alias("why"))
    found = text.unionByName(markup).unionByName(office)
    for name, reader in extra.items():
        own = reader(listed.where((F.col("suffix") == name) & F.col("error").isNull()).select("path", "bytes"))
        found = found.unionByName(own.select("path", normalize(F.col("text")).alias("text"), F.lit(False).alias("encoding_loss"), F.col("error").alias("why")))
    known = sorted(TEXT | MARKUP | OFFICE | set(extra))
    missing = F.when(~F.col("suffix").isin(known), F.when(F.col("suffix").isin(*IMAGE_SUFFIXES), "needs a recogniser").otherwise("needs a reader"))
    out = listed.join(found, "path", "left")
    return out.select("path", "bytes", "format", "text", F.coalesce("encoding_loss", F.lit(False)).alias("encoding_loss"), F.coalesce("error", missing, "why").alias("error"))
