"""Glossaries: a struct of ``preferred`` (term -> translation) and ``keep`` (terms that stay as they are), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import stripped

TYPE = "struct<preferred:map<string,string>,keep:array<string>>"


def _truthy(value: Column) -> Column:
    """Of a JSON value's text, whether it counts as true: not null, false, zero or empty."""
    return F.coalesce(~value.isin("", "false", "null", "0", "0.0", "[]", "{}"), F.lit(False))


def parse(payload: Column) -> Column:
    """The glossary in a JSON object from terms to translations or to objects (preferred, do_not_translate); null for other JSON.

    A term without a translation, with itself as translation (whatever the case) or marked do_not_translate is kept.
    """
    entries = F.map_entries(F.try_parse_json(payload).cast("map<string,variant>"))

    def read(e: Column) -> Column:
        term, value = stripped(e["key"]), e["value"]
        nested = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
        given = F.when(nested, F.try_variant_get(value, "$.preferred", "string")).otherwise(F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("None")))
        target = stripped(F.coalesce(given, F.lit("")))
        marked = nested & _truthy(F.coalesce(F.try_variant_get(value, "$.do_not_translate", "string"), F.lit("")))
        same = F.lower(target) == F.lower(term)
        # An object with an empty translation says nothing.
        silent = nested & given.isNotNull() & (target == "") & ~marked
        return F.struct(term.alias("term"), target.alias("target"), (marked | same | (target == "")).alias("keep"), ((term == "") | silent).alias("no"))

    found = F.filter(F.transform(entries, read), lambda x: ~x["no"])
    # Terms that differ in white space alone: the last one counts.
    pairs = F.filter(found, lambda x: ~x["keep"])
    preferred = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["term"]), F.create_map(x["term"], x["target"])))
    keep = F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x["keep"]), lambda x: x["term"])))
    is_object = F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT")
    return F.when(is_object, F.struct(preferred.alias("preferred"), keep.alias("keep")))


def merge(one: Column, two: Column) -> Column:
    """Both glossaries; of two translations of a term, the second's."""
    left = F.map_filter(one["preferred"], lambda k, v: ~F.map_contains_key(two["preferred"], k))
    both = F.struct(F.map_concat(left, two["preferred"]).alias("preferred"), F.array_sort(F.array_union(one["keep"], two["keep"])).alias("keep"))
    return F.when(one.isNull(), two).when(two.isNull(), one).otherwise(both)


def tokens(glossary: Column) -> Column:
    """Kept terms and translations, stripped, without empty ones, sorted: what both passes must share."""
    both = F.transform(F.array_union(glossary["keep"], F.map_values(glossary["preferred"])), stripped)
    return F.array_sort(F.array_distinct(F.filter(both, lambda t: t != "")))


def _quoted(term: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(term, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    single, double = F.contains(term, F.lit("'")), F.contains(term, F.lit('"'))
    plain = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(plain)


def prompt_block(glossary: Column) -> Column:
    """The glossary's lines for a prompt: kept terms first, then the translations of other terms, each sorted; empty if there are none."""
    keep = F.transform(F.array_sort(glossary["keep"]), lambda t: F.concat(F.lit("- "), _quoted(t), F.lit(": keep unchanged (do not translate)")))
    others = F.map_filter(glossary["preferred"], lambda k, v: ~F.array_contains(glossary["keep"], k))
    pairs = F.transform(F.array_sort(F.map_entries(others)), lambda e: F.concat(F.lit("- "), _quoted(e["key"]), F.lit(" → "), _quoted(e["value"])))
    lines = F.concat(keep, pairs)
    return F.coalesce(F.when(F.size(lines) > 0, F.concat(F.lit("Glossary terms:\n"), F.array_join(lines, "\n"))), F.lit(""))


def files(spark, path: str) -> DataFrame:
    """path, glossary, error of JSON files; what is no JSON object has an error and no glossary."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), parse(F.col("value")).alias("glossary"))
    return rows.withColumn("error", F.when(F.col("glossary").isNull(), "CONFIGURATION_ERROR"))
