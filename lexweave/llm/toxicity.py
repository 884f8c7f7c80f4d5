"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic texts among the training rows; the unlabelled set is a sample of all texts.  A text is
the set of its lower-cased words and their beginnings of PREFIXES bytes; the FEATURES of these whose shares differ most between the
two sets (two-proportion z) make a binary vector.  A numpy logistic model minimises the class-prior-corrected risk
pi E_p[l+] + max(0, E_u[l-] - pi E_p[l-]); where the bracket falls below zero, its gradient is reversed.  The
prior pi is the share of toxic rows among the labelled training rows.

The bias is then moved so that THRESHOLD stands MARGIN of the way from the CLEAN quantile of the labelled clean training rows to the
median of the positives, where that is higher; the order of scores stays that of the fitted model.

Fitting uses at most SAMPLE positives, SAMPLE labelled clean and SAMPLE unlabelled texts, those with the smallest digests of their
ids; scores are given to every whole text.  Held-out rows (crc32 of the id as text, mod 3, is 1) give no labels.

Defined results: null is empty text, scored like any other; several labels of an id count as toxic if one does; labels that are null, or
of a null id, say nothing; rows without an id are scored, are not held out and give no labels; rows that repeat an id are scored each
and all stand for its label; equal texts have equal scores, ties of digests go to the smaller id; texts of any length are read whole;
without positives or unlabelled texts every score is the prior; columns in ``keep`` may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import materialize, text_of

SAMPLE = 20_000
FEATURES = 512
PREFIXES = (4, 5, 6, 7)
CLEAN = 0.999
MARGIN = 0.05
THRESHOLD = 0.7
_SEPARATORS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "replace").translate(_SEPARATORS).split())


def features_of(text: str) -> set[bytes]:
    words = words_of(text)
    return words.union(w[:k] + b"*" for w in words for k in PREFIXES if len(w) > k)


class Index:
    """Places of the chosen features; most words of a text are told from them by their first bytes."""

    def __init__(self, features: tuple[bytes, ...]):
        self.at = {w: i for i, w in enumerate(features)}
        self.heads = frozenset(w[: PREFIXES[0]] for w in features)

    def places(self, text: str) -> list[int]:
        """The places of features_of(text) that are in the index, sorted."""
        near = [w for w in words_of(text) if w[: PREFIXES[0]] in self.heads]
        found = {self.at[x] for w in near for x in (w, *(w[:k] + b"*" for k in PREFIXES if len(w) > k)) if x in self.at}
        return sorted(found)


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


@dataclass(frozen=True)
class Model:
    words: tuple[bytes, ...]
    weights: np.ndarray
    bias: float

    def score(self, text: str, index: Index) -> float:
        at = index.places(text)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at].sum(), -30, 30))))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model, by Adam on the non-negative risk over whole matrices."""
    xp, xu = positive.astype(np.float32), unlabelled.astype(np.float32)
    theta = np.zeros(xp.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    grad = lambda x, g: np.append(x.T @ g.astype(np.float32), g.sum()) / len(g)
    for t in range(1, rounds + 1):
        zp, zu = xp @ theta[:-1].astype(np.float32) + theta[-1], xu @ theta[:-1].astype(np.float32) + theta[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_negative = grad(xu, sigmoid(zu)) - prior * grad(xp, sigmoid(zp))
        g = prior * grad(xp, sigmoid(zp) - 1) + g_negative if negative >= 0 else -g_negative
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _sampled(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """The texts to fit on (text, kind: p, u or n, labelled clean) and the class prior."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("k")).first()
    prior = min(0.9, max(0.001, (counts["k"] or 0) / counts["n"])) if counts["n"] else 0.01
    first = lambda df: df.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(SAMPLE)
    ids = first(known.where("toxic = 1").select("doc_id")).withColumn("kind", F.lit("p"))
    ids = ids.unionByName(first(known.where("toxic = 0").select("doc_id")).withColumn("kind", F.lit("n")))
    ids = ids.unionByName(first(documents.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL")).withColumn("kind", F.lit("u")))
    # At most 3 * SAMPLE ids, of whose texts, where rows repeat an id, one stands for all: so many rows and no more are read by the driver.
    rows = documents.select(F.col("doc_id").cast("long"), text_of().alias("text")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "kind").agg(F.min("text").alias("text")).select("text", "kind"), prior


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    sample, prior = _sampled(documents, labels)
    nothing = Model((), np.zeros(0), float(np.log(prior / (1 - prior))))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = [b"", *features_of(text)]  # the empty word counts texts
                p = int(kind == "p")
                yield pa.RecordBatch.from_pydict({"word": found, "p": [p] * len(found), "u": [1 - p] * len(found)}, pa.schema([("word", pa.binary()), ("p", pa.int64()), ("u", pa.int64())]))

    counted = sample.where("kind <> 'n'").mapInArrow(shares, "word binary, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    counted = materialize(counted, "toxic-words")
    total = counted.where("length(word) = 0").first()
    if total is None or not total["p"] or not total["u"]:
        return nothing
    n_p, n_u = float(total["p"]), float(total["u"])
    pooled = (F.col("p") + F.col("u") + 1) / F.lit(n_p + n_u + 2)
    z = (F.col("p") / F.lit(n_p) - F.col("u") / F.lit(n_u)) / F.sqrt(pooled * (1 - pooled) * F.lit(1 / n_p + 1 / n_u))
    chosen = counted.where("length(word) > 0").orderBy(F.abs(z).desc(), "word").limit(FEATURES).select("word").collect()
    words = tuple(bytes(r["word"]) for r in chosen)
    if not words:
        return nothing
    index = Index(words)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.zeros((b.num_rows, len(words)), dtype=np.uint8)
            for i, text in enumerate(b.column(0).to_pylist()):
                bits[i, index.places(text)] = 1
            packed = [r.tobytes() for r in np.packbits(bits, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), b.column(1)], names=["bits", "kind"])

    rows = sorted((r["kind"], bytes(r["bits"])) for r in sample.mapInArrow(vectors, "bits binary, kind string").collect())  # at most 3 * SAMPLE rows of FEATURES bits
    matrix = lambda kind: np.unpackbits(np.frombuffer(b"".join(x for k, x in rows if k == kind), dtype=np.uint8).reshape(-1, (len(words) + 7) // 8), axis=1, count=len(words))
    weights, bias = fit_nnpu(matrix("p"), matrix("u"), prior)
    return Model(words, weights, bias + shift(matrix("p") @ weights + bias, matrix("n") @ weights + bias))


def shift(positive: np.ndarray, clean: np.ndarray) -> float:
    """What moves the threshold between the logits of labelled clean and of positive texts; nothing where they are not apart."""
    if not len(clean):
        return 0.0
    low, high = np.quantile(clean, CLEAN), np.median(positive)
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - (low + MARGIN * (high - low))) if low < high else 0.0


def score(documents: DataFrame, labels: DataFrame, keep: list[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, with the columns in ``keep``."""
    model = fit(documents, labels)
    index = Index(model.words)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(x.as_py(), index) for x in texts], pa.float64())  # one text at a time as a Python string

    # Texts alone go to Python and scores alone come back: the kept columns, which may hold the text again, stay with Spark.
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), scored(text_of()).alias("score"), F.struct(F.lit(0), *keep).alias("__kept"))
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    return rows.select("doc_id", "held_out", "score", predicted, *[F.col(f"__kept.`{c}`").alias(c) for c in keep])


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    held = documents.select("doc_id", "text", F.struct(*documents.columns).alias("__row"))
    return score(held, labels, keep=["__row"]).where("predicted = 0").select("__row.*")
