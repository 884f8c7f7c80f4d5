"""How the sources of a language differ in their words: an audit by counts and joins alone.

Terms are what lies between runs of other ASCII characters in lower-cased text.  A document's terms and, after them, its distinct ones are
exploded together and counted by (lang, source, term) in one pass, combined before they are shuffled.  A language keeps the terms of at
least ``least`` of its documents, which a window over (lang, term) finds; only their counts are written.  Its groups (a language and a source) are crossed with the kept terms, so that absent terms are zeros: the
kept terms are dealt over SALTS and the groups, a small table, repeated for each salt, so no language is one task's.  The dense
table joins itself on language and term, one order of each pair of sources (the value is the same for both); values are added up
per pair before a shuffle, and windows rank them.  Probabilities and values are whole numbers, computed in decimals where a product would
pass 64 bits.

Defined results: null text, language and source are empty ones, which are a text, a language and a source like others; every row is
a document, also one that repeats an id or another row; long texts are read whole; a language without kept terms has pairs of value
zero and no terms; a group without terms takes part with zeros; equal values are ranked by the item's UTF-8 bytes; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import materialize, text_of

APART = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000
#: Counts up to this times SCALE are below 2^63.
MOST = 9_000_000_000
LEAST = 10
TOP = 10
SALTS = 32


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact for counts of any table."""
    count, total = (count + 2).cast("long"), (total + 2 * kept).cast("long")
    wide = F.call_function("div", count.cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(19,0)")).cast("long")
    return F.when(count <= MOST, F.call_function("div", count * F.lit(SCALE).cast("long"), total)).otherwise(wide) + 1


def value(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); probabilities are at most SCALE + 1, so the square stays below 2^63."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Of kept terms: lang, source, term, n, lang_n (of the term in the whole language) where n > 0; and lang, term, lang_n."""
    text, lang = text_of(), text_of("lang").alias("lang")
    # Where all characters are ASCII, lower() does what the contract asks and is cheaper.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    texts = documents.select(lang, text_of("source").alias("source"), F.split(low, APART).alias("terms"))
    # From position k on each term of the document comes once.
    rows = texts.select("lang", "source", F.size("terms").alias("k"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("pos", "term")).where("term <> ''")
    counts = rows.groupBy("lang", "source", "term").agg(F.count_if(F.expr("pos < k")).alias("n"), F.count_if(F.expr("pos >= k")).alias("df"))
    of_lang = Window.partitionBy("lang", "term")
    counts = counts.select("lang", "source", "term", "n", F.sum("n").over(of_lang).alias("lang_n"), F.sum("df").over(of_lang).alias("df"))
    found = materialize(counts.where(F.col("df") >= least).drop("df"), "term-counts")
    return found, materialize(found.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")), "kept-terms")


def audit(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    found, kept = term_counts(documents, least)
    found = found.drop("lang_n")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = documents.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = materialize(groups, "groups")

    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("salt")
    dealt = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dense = kept.select("lang", "term", "lang_n", salt).join(dealt, ["lang", "salt"]).join(found, ["lang", "source", "term"], "left")
    p, q = probability(F.coalesce("n", F.lit(0)), F.col("total"), F.col("v")), probability(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    dense = materialize(dense.select("lang", "source", "term", F.coalesce("n", F.lit(0)).alias("n"), p.alias("p"), q.alias("q")), "dense")

    one, two = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other"))
    summed = one.join(two, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(value(F.col("p"), F.col("other"))).alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("o")
    summed = summed.select("lang", both, "value").select("lang", "o.*", "value")
    names = groups.select("lang", "source")
    pairs = names.join(names.withColumnRenamed("source", "item"), "lang").where("source <> item")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.join(summed, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    terms = dense.where("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(terms)
