"""Language detection by character n-grams: profiles counted from labelled text, log-likelihoods added up by words.

Training counts the words of each language first, so the grams of a frequent word are made once; a profile keeps a language's ``size``
commonest grams of one to three characters (a word has a blank on either side).  The profiles of all languages are one table of at
most ``size`` x MOST_LANGUAGES rows, which is made once and broadcast.  Scores are thousandths of natural logarithms as whole numbers, so sums do not
depend on their order, and a word's grams add up to the same in every document: a task does it once for a word of its texts.  A document's evidence is the grams of its sample's distinct words; as grams of a word depend on each other, n of
them count as sqrt(n) in the confidence, which is a posterior over the languages of the profile.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import stripped
from lexweave.operators.chunking import language_sample
from lexweave.operators.detect import SHORT, script_of

LONGEST = 3
SIZE = 4000
MOST_LANGUAGES = 64
SCALE = 1000
#: Words whose sums a task keeps.
MOST_WORDS = 1 << 17


class Profile(NamedTuple):
    grams: DataFrame  # gram, scores (of the languages in their order)
    languages: list[str]


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def _grams(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, gram of rows with a word: all grams that begin at each place of the word between blanks, but blanks alone."""
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    places = rows.select(*keep, padded.alias("w"), F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("i"))
    n = F.length("w") - F.col("i") + 1
    own = [F.when((n >= k) & ((F.col("i") > 1) | F.lit(k > 1)), F.substring("w", F.col("i"), F.lit(k))) for k in range(1, LONGEST + 1)]
    return places.select(*keep, F.explode(F.array(*own)).alias("gram")).where("gram IS NOT NULL")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, words) each language's words in a batch with their numbers."""
    for b in batches:
        langs = b.column("lang").dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            found = b.column("words").filter(pc.equal(langs.indices, i)).flatten().value_counts()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), found.field("values"), found.field("counts")], names=["lang", "word", "n"])


def profile(labelled: DataFrame, size: int = SIZE) -> Profile:
    """Of labelled texts (lang, text); rows without a language are left out.  More than MOST_LANGUAGES languages are refused."""
    known = labelled.where("lang IS NOT NULL").select("lang", F.col("text").cast("string").alias("text"))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return Profile(known.select(F.col("text").alias("gram"), F.array(F.lit(0).cast("long")).alias("scores")).limit(0), [])
    counted = known.select("lang", words(F.col("text")).alias("words")).mapInArrow(_counts, "lang string, word string, n long")
    counted = counted.where("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = _grams(counted, "lang", "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = grams.withColumn("place", F.row_number().over(most)).where(F.col("place") <= size)
    # At most size x MOST_LANGUAGES rows: the whole profile is small, and every detection uses it again.
    own: dict[str, dict[str, int]] = {c: {} for c in languages}
    for r in kept.select("lang", "gram", "n").collect():
        own[r["lang"]][r["gram"]] = r["n"]
    totals = {c: sum(own[c].values()) for c in languages}
    score = lambda c, gram: -floor(0.5 - SCALE * log((own[c].get(gram, 0) + 0.5) / (totals[c] + size / 2)))
    rows = [(gram, [score(c, gram) for c in languages]) for gram in sorted(set().union(*own.values()))]
    return Profile(labelled.sparkSession.createDataFrame(rows, "gram string, scores array<long>"), languages)


def _scored(asked: DataFrame, of: Profile) -> DataFrame:
    """asked (row, script, words) with n (known grams of its words) and s0, s1 ... (each language's sum over them) in place of words."""
    names = ["n", *(f"s{i}" for i in range(len(of.languages)))]
    grams = asked.sparkSession.sparkContext.broadcast({r["gram"]: [1, *r["scores"]] for r in of.grams.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = {gram: np.array(x, dtype=np.int64) for gram, x in grams.value.items()}
        none = np.zeros(len(names), dtype=np.int64)
        known: dict[str, np.ndarray] = {}

        def sums(word: str) -> np.ndarray:
            w = f" {word} "
            own = [scores[gram] for k in range(1, LONGEST + 1) for i in range(len(w) + 1 - k) if (gram := w[i : i + k]) in scores]  # a blank alone is no gram of a profile
            return np.sum(own, axis=0) if word and own else none

        for b in batches:
            lists = b.column("words")
            coded = lists.flatten().dictionary_encode()
            if len(known) > MOST_WORDS:
                known.clear()
            own = coded.dictionary.to_pylist()
            for word in own:
                if word not in known:
                    known[word] = sums(word)
            table = np.array([known[word] for word in own], dtype=np.int64).reshape(-1, len(names))
            at, ends = coded.indices.to_numpy(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            columns = []
            for i in range(len(names)):
                running = np.concatenate(([0], np.cumsum(table[at, i])))[ends]
                columns.append(pa.array(np.diff(running, prepend=0)))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("script"), *columns], names=["row", "script", *names])

    return asked.mapInArrow(run, asked.select("row", "script", *(F.lit(0).cast("long").alias(c) for c in names)).schema)


def detect(documents: DataFrame, text: str, of: Profile) -> DataFrame:
    """The table's columns but ``text``, and found: (lang, confidence), null where the sample says nothing.

    Rows stay as they are, so repeated ones are detected each.  A script decides by itself (``detect.script_of``); a sample below SHORT
    characters, or without any known gram, has no language.  Equal scores go to the first language.
    """
    carried = [c for c in documents.columns if c != text]
    rows = documents.select(F.struct(*carried).alias("row"), stripped(language_sample(F.coalesce(F.col(text), F.lit("")))).alias("sample"))
    rows = rows.select("row", "sample", F.when(F.length("sample") >= SHORT, script_of(F.col("sample"))).alias("script"))
    if not of.languages:
        return rows.select("row.*", F.col("script").alias("found"))
    distinct = F.when((F.length("sample") >= SHORT) & F.col("script").isNull(), F.array_distinct(words(F.col("sample"))))
    scored = _scored(rows.select("row", "script", distinct.alias("words")), of)
    ranked = [F.struct((-F.col(f"s{i}")).alias("low"), F.lit(c).alias("lang")) for i, c in enumerate(of.languages)]
    best = F.least(*ranked) if len(ranked) > 1 else ranked[0]
    shares = [F.exp((F.col(f"s{i}") + best["low"]) / (SCALE * F.sqrt("n"))) for i in range(len(of.languages))]
    found = F.struct(best["lang"].alias("lang"), F.round(1 / sum(shares[1:], shares[0]), 4).alias("confidence"))
    return scored.select("row.*", F.coalesce("script", F.when(F.col("n") > 0, found)).alias("found"))
