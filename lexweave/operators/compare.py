"""Sentence-level comparison of two passes: positional pairs, edit-based similarity, protected tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import protected_tokens, sentences

SIMILARITY_THRESHOLD = 92.0


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one integer.

    What both begin and end with is common anyway, so only the middle goes through the table.
    """
    low, least = 0, min(len(a), len(b))
    while low < least and a[low] == b[low]:
        low += 1
    end = 0
    while end < least - low and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[low : len(a) - end], b[low : len(b) - end]
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return low + end + len(a) - row.bit_count()


def indel_ratio(one: str, two: str) -> Column:
    """Twice the longest common subsequence over both lengths, in percent; two empty strings are equal."""
    return F.pandas_udf(_ratios, "double")(one, two)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([100.0 if x == y else 200.0 * _common(x, y) / (len(x) + len(y)) for x, y in zip(a.fillna(""), b.fillna(""))], dtype="float64")


def sentence_pairs(rows: DataFrame, keys: list[str], one: str, two: str) -> DataFrame:
    """keys, sentence_index, translation_1, translation_2; the shorter side is filled up with empty sentences."""
    a, b = sentences(F.col(one)), sentences(F.col(two))
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("translation_1"), y.alias("translation_2")))
    out = rows.select(*keys, F.posexplode(pairs).alias("sentence_index", "p"))
    blank = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit("")).alias(c)
    return out.select(*keys, "sentence_index", blank("translation_1"), blank("translation_2"))  # sentences are never empty, so no pair is


def flagged(pairs: DataFrame, threshold: float = SIMILARITY_THRESHOLD, glossary: Column | None = None) -> DataFrame:
    """Pairs under the threshold or with other protected tokens; the glossary's tokens count on both sides."""
    g = F.array().cast("array<string>") if glossary is None else glossary
    tokens = lambda c: F.array_sort(F.array_union(protected_tokens(F.col(c)), g))
    empty = (F.col("translation_1") == "") | (F.col("translation_2") == "")
    same = F.col("translation_1") == F.col("translation_2")
    # Equal pairs are never flagged, and those with an empty side, whose similarity is 0, always; all others are measured in the same pass.
    differs = empty | (tokens("translation_1") != tokens("translation_2"))
    measured = pairs.where(~same).withColumns({"similarity": indel_ratio("translation_1", "translation_2"), "protected_token_mismatch": differs})
    return measured.where((F.col("similarity") < threshold) | F.col("protected_token_mismatch"))
