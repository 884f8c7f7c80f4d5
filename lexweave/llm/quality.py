"""Perplexity under an interpolated modified Kneser-Ney bigram model of subword tokens, trained on trusted text.

p(b | a) = (c - D(c)) / c(a) + gamma(a) * p1(b) with the three modified discounts from the counts of counts; p1 interpolates the
discounted continuation counts with the uniform share of the tokenizer's vocabulary in the same way.  Tokens are those of a
given vocabulary file, over lower-cased text, so the tables of single tokens (gamma and p1) are bounded by the vocabulary and
go to all tasks.  With them log p(b | a) = log gamma(a) + log p1(b) + a correction that only bigrams of the model have.  The
corrections of the commonest bigrams, at most HEAD, go to all tasks as well, which also keeps hot keys out of shuffles; all other
bigrams of the documents meet the rest of the model in one join sharded by bigram, and the sums return to the documents.  Terms
are added as whole multiples of 1 / SCALE, so sums do not depend on the order of rows.

A document is kept if its perplexity is at most the QUANTILE quantile of the held-out trusted documents of its language, times
SLACK.  One trusted text in FOLDS is held out: the model does not count it, as text that a model was trained on has a far lower
perplexity than equal unseen text.  Texts are dealt by their own digest, so that exact copies are on one side.

Defined results: null is empty text, of perplexity 1 and kept; every row gets its own row, also where ids are null or repeat, and
equal texts get equal perplexities; a null id is never trusted; an id with several labels is trusted if one says so; languages
(also the null one) without held-out text use the quantile of all held-out documents; without held-out text all are kept; texts
of any length are read whole, in pieces of bounded memory; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import materialize, text_of
from lexweave.llm.packing import default_tokenizer, shared_coder

QUANTILE = 0.99
SLACK = 1.5
FOLDS = 5
HEAD = 1 << 16
SCALE = 1 << 24
#: Characters of text that are counted at a time, and bigrams that a task holds before it passes their counts on.
GROUP = 1 << 22
HELD = 1 << 20
_BITS = 21  # of a token id in a bigram's key
_START = (1 << _BITS) - 1


def vocabulary_size(path: str) -> int:
    return shared_coder(path).size


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    low, held = 0, 0
    for i, t in enumerate(texts):
        if i > low and held + len(t) > GROUP:
            yield low, texts[low:i]
            low, held = i, 0
        held += len(t)
    if low < len(texts):
        yield low, texts[low:]


def bigrams_of(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first and second tokens of all bigrams, and their numbers by text; each text starts with _START."""
    coder = shared_coder(path)
    ids = [np.array([_START, *coder.ids(t.lower())], dtype=np.int64) for t in texts]
    flat = np.concatenate(ids)
    sizes = np.array([len(x) for x in ids])
    inner = np.ones(len(flat), dtype=bool)
    inner[np.cumsum(sizes) - sizes] = False
    at = np.flatnonzero(inner)
    return flat[at - 1], flat[at], sizes - 1


def count_bigrams(texts: DataFrame, path: str) -> DataFrame:
    """a, b, n of the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(keys >> _BITS), pa.array(keys & _START), pa.array(counts)], names=["a", "b", "n"])
        for batch in batches:
            for _, part in _groups(batch.column(0).to_pylist()):
                a, b, _ = bigrams_of(part, path)
                found, n = np.unique((a << _BITS) | b, return_counts=True)
                keys, at = np.unique(np.concatenate((keys, found)), return_inverse=True)
                counts = np.bincount(at, np.concatenate((counts, n)), len(keys)).astype(np.int64)
                if len(keys) > HELD:
                    yield rows()
                    keys, counts = keys[:0], counts[:0]
        yield rows()

    return texts.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from the numbers of kinds that occur 1 to 4 times; within (0, count)."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    one = lambda k, n, more: min(k - 0.01, max(0.01, k - (k + 1) * y * more / n)) if n else k * 0.5
    return one(1, n1, n2), one(2, n2, n3), one(3, n3, n4)


def _discounted(column: str, counted: DataFrame):
    kinds = {r[0]: r[1] for r in counted.where(F.col(column) <= 4).groupBy(column).count().collect()}
    d = discounts(*[kinds.get(k, 0) for k in (1, 2, 3, 4)])
    return F.when(F.col(column) == 1, d[0]).when(F.col(column) == 2, d[1]).otherwise(d[2])


class Model:
    """log_gamma by first token, log_p1 by second token (for others: unknown), corrections: key, term of the model's bigrams."""

    def __init__(self, grams: DataFrame, size: int):
        spark = grams.sparkSession
        discount = _discounted("n", grams)
        first = materialize(grams.groupBy("a").agg(F.sum("n").alias("c"), (F.sum(discount) / F.sum("n")).alias("gamma")), "kn-first")
        second = materialize(grams.groupBy("b").agg(F.count("*").alias("kinds")), "kn-second")
        # At most a row for each token of the vocabulary in either.
        gammas, kinds = first.select("a", "gamma").toArrow(), second.withColumn("d", _discounted("kinds", second)).toArrow()
        b, n, d = (kinds[c].to_numpy().astype(np.float64) for c in ("b", "kinds", "d"))
        total = n.sum()
        rest = d.sum() / total / size if total else 1.0 / size
        p1 = (n - d) / total + rest if total else n
        self.unknown = math.log(rest)
        self.log_gamma = dict(zip(gammas["a"].to_pylist(), np.log(gammas["gamma"].to_numpy()).tolist()))
        self.log_p1 = dict(zip(b.astype(np.int64).tolist(), np.log(p1).tolist()))
        shares = spark.createDataFrame(list(self.log_p1.items()), "b long, log_p1 double")
        low = F.log("gamma") + F.col("log_p1")
        terms = grams.join(F.broadcast(first), "a").join(F.broadcast(shares), "b")
        terms = terms.select((F.shiftleft("a", _BITS) + F.col("b")).alias("key"), "n", (F.log((F.col("n") - discount) / F.col("c") + F.exp(low)) - low).alias("term"))
        self.corrections = materialize(terms.withColumn("term", F.round(F.col("term") * SCALE).cast("long")), "kn-terms")

    def head(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Keys (sorted) and terms of the bigrams that occur at least ``least`` times, at most HEAD, and ``least``."""
        # Counts in bins of an eighth of an octave: at most some hundred rows.
        level = F.floor(F.log2("n") * 8).cast("int")
        bins = self.corrections.groupBy(level.alias("level")).agg(F.count("*").alias("kinds"), F.min("n").alias("least")).collect()
        held, least = 0, 1 << 62
        for r in sorted(bins, key=lambda r: -r["level"]):
            held += r["kinds"]
            if held > HEAD:
                break
            least = r["least"]
        rows = self.corrections.where(F.col("n") >= least).select("key", "term").toArrow()
        keys, terms = rows["key"].to_numpy(), rows["term"].to_numpy()
        order = np.argsort(keys)
        return keys[order], terms[order], least


def _dense(values: dict[int, float], default: float) -> np.ndarray:
    """Terms by token id; the last place is _START's."""
    out = np.full(max([0, *(k for k in values if k != _START)]) + 2, round(default * SCALE), dtype=np.int64)
    for k, v in values.items():
        out[-1 if k == _START else k] = round(v * SCALE)
    return out


def _at(table: np.ndarray, ids: np.ndarray, default: float) -> np.ndarray:
    known = (ids < len(table) - 1) | (ids == _START)
    return np.where(known, table[np.where(ids == _START, len(table) - 1, np.where(known, ids, 0))], round(default * SCALE))


def score(documents: DataFrame, labels: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, kept."""
    path = tokenizer or default_tokenizer()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    held_out = F.pmod(F.xxhash64(F.lit("held out"), "text"), F.lit(FOLDS)) == 0
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # Labels grow with the documents, so this join is by shards at every size.
    trusted = docs.where(~held_out).join(good.hint("merge"), "doc_id", "left_semi").select("text")
    grams = materialize(count_bigrams(trusted, path), "kn-bigrams")
    model = Model(grams, vocabulary_size(path))
    keys, terms, least = model.head()
    unknown, gamma, p1 = model.unknown, _dense(model.log_gamma, 0.0), _dense(model.log_p1, model.unknown)

    def parse(texts: list[str]):
        """Of every text: the sum of the terms known everywhere, and its bigrams; key, text and number of the other bigrams."""
        a, b, sizes = bigrams_of(texts, path)
        owner = np.repeat(np.arange(len(texts)), sizes)
        kinds, at = np.unique((a << _BITS) | b, return_inverse=True)
        place = np.minimum(np.searchsorted(keys, kinds), max(0, len(keys) - 1))
        common = keys[place] == kinds if len(keys) else np.zeros(len(kinds), dtype=bool)
        extra = np.where(common, terms[place], 0) if len(keys) else np.zeros(len(kinds), dtype=np.int64)
        value = _at(gamma, a, 0.0) + _at(p1, b, unknown) + extra[at]
        ends = np.cumsum(sizes)
        sums = np.concatenate(([0], np.cumsum(value)))
        return sums[ends] - sums[ends - sizes], sizes, kinds, at, owner, common

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, part in _groups(batch.column("text").to_pylist()):
                sums, sizes, *_ = parse(part)
                own = [batch.column(c).slice(low, len(part)) for c in ("doc_id", "lang", "row", "held")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes.astype(np.int64)), pa.array(sums)], names=["doc_id", "lang", "row", "held", "n", "total"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for low, part in _groups(batch.column("text").to_pylist()):
                _, _, kinds, at, owner, common = parse(part)
                rare = ~common[at]
                pairs, n = np.unique(owner[rare] * len(kinds) + at[rare], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(rows[low + pairs // max(1, len(kinds))]), pa.array(kinds[pairs % max(1, len(kinds))]), pa.array(n)], names=["row", "key", "n"])

    # The row's own key: equal rows share it, and so do their sums, of which only the ratio counts.
    keyed = docs.select("doc_id", "lang", F.xxhash64("doc_id", F.xxhash64("text")).alias("row"), held_out.alias("held"), "text")
    scored = materialize(keyed.mapInArrow(base, "doc_id long, lang string, row long, held boolean, n long, total long"), "kn-rows")
    tail = model.corrections.where(F.col("n") < least).select("key", "term")
    found = keyed.select("row", "text").mapInArrow(others, "row long, key long, n long").join(tail, "key")
    found = found.groupBy("row").agg(F.sum(F.col("n") * F.col("term")).alias("total"))
    sums = scored.select("row", "n", "total").unionByName(found.select("row", F.lit(0).cast("long").alias("n"), "total"))
    sums = sums.groupBy("row").agg(F.sum("n").alias("all_n"), F.sum("total").alias("all_total"))
    perplexity = F.when(F.col("all_n") == 0, 1.0).otherwise(F.exp(-(F.col("all_total") / F.col("all_n")) / SCALE))
    out = scored.drop("total").join(sums, "row").withColumn("perplexity", perplexity)
    out = materialize(out.select("doc_id", "lang", "held", F.col("n").alias("n_tokens"), "perplexity"), "perplexity")
    unseen = materialize(out.where("held AND n_tokens > 0").join(good, "doc_id", "left_semi"), "held-out")
    by_lang = unseen.groupBy("lang").agg(F.percentile_approx("perplexity", QUANTILE, 10000).alias("most"))
    overall = unseen.agg(F.percentile_approx("perplexity", QUANTILE, 10000)).first()[0]
    most = F.coalesce("most", F.lit(overall if overall is not None else math.inf)) * SLACK
    kept = (F.col("n_tokens") == 0) | (F.col("perplexity") <= most)
    return out.join(by_lang, "lang", "left").select("doc_id", "lang", "n_tokens", "perplexity", kept.alias("kept"))
