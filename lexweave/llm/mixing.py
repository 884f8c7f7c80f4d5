"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. ``targets``: every source's share of the mix in words, by weight, none above ``most`` times what it has.
2. A keyed digest puts each source's documents into BLOCKS blocks and, within a block, into an order; both are
   permutations that a rerun repeats.  A source gives ``passes`` whole passes over its blocks and, for the rest of
   its quota, the first blocks of the permuted order.  Where the quota ends inside a block, the block's sub-blocks
   and then its documents are summed up in order, so no step sums more than BLOCKS rows of a source in one task
   but the last, which sees about 1 / BLOCKS**2 of the source.
3. ``splitting_tree``: the exact block quotas are parted among the output shards.  At each node the left half's
   quota vector is a multivariate-hypergeometric draw from the node's, so the shards' mixes differ only as chance
   has it and their sums are exact.  Shards draw disjoint runs of the permuted blocks and shuffle their documents.
   Sources are parted in strata of STRATUM, each by a tree of its own in a task of its own: a draw has at most
   STRATUM * BLOCKS * (most + 1) units, however many sources there are, and the driver holds no runs.

What a document gives follows from the units that the tree dealt: ``taken`` sums them, ``shards`` names them.

Defined results: a null text has no words; a document without words is never taken; the null source comes last;
equal rows are separate documents, but rows that share an id share its place in the order, ties by size; a null id is one id; a text of
any length counts whole; other columns are kept by ``mixed_documents`` and ignored by ``mix``; the mix of an empty table is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import WORD_PATTERN, materialize, text_of

BLOCKS = 4096
#: Sources that one tree parts: at most 1,024 * 4,096 * 3 units, as numpy draws from fewer than 10**9.
STRATUM = 1024
#: Words of a piece, the part of a shard that one task shuffles.
PIECE_WORDS = 16_000_000
#: Sources up to which their table (600 bytes each) goes to all tasks; more are joined by shards.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class MixPlan:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # by rank of the source, repeating
    share: float = 1.5  # size of the mix, of all words
    most: float = 2.0  # a source's target, of its words, at most
    shards: int = 64
    seed: str = "mix-1"


def targets(sizes: list[int], plan: MixPlan) -> list[float]:
    """Targets in words of sources of these sizes, in rank order: by weight, the excess over ``most`` reshared by weight."""
    weights = [plan.weights[i % len(plan.weights)] for i in range(len(sizes))]
    order = sorted(range(len(sizes)), key=lambda i: (plan.most * sizes[i] / weights[i], i))
    left, weight = plan.share * sum(sizes), sum(weights)
    level = 0.0
    for i in order:  # those that the level would lift above their most come first
        level = left / weight
        if level <= plan.most * sizes[i] / weights[i]:
            break
        left -= plan.most * sizes[i]
        weight -= weights[i]
    return [min(plan.most * s, level * w) for s, w in zip(sizes, weights)]


def splitting_tree(quotas: np.ndarray, shards: int, seed: int, stratum: int = 0) -> np.ndarray:
    """Blocks of each source (columns) in each shard (rows); columns sum to the quotas, rows to equal numbers of blocks or one more."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    nodes = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while nodes:
        low, high, node = nodes.pop()
        if high - low == 1:
            out[low] = node
            continue
        mid = (low + high) // 2
        draw = int(node.sum()) * (mid - low) // (high - low)
        left = np.random.default_rng([seed, stratum, low, high]).multivariate_hypergeometric(node, draw, method="marginals")
        nodes += [(low, mid, left), (mid, high, node - left)]
    return out


def _dealt(sources: DataFrame, plan: MixPlan) -> DataFrame:
    """skey, runs: for each shard, how many units of the source it and the shards before it have."""
    shards, seed = plan.shards, _number(plan.seed)

    def split(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        # Blocks that each source gives: whole passes, and those of the permuted order up to where its quota ends.
        quotas = (group["passes"] * BLOCKS + group["at1"] + 1).to_numpy(dtype=np.int64)
        tree = splitting_tree(quotas, shards, seed, int(group["rank"].iloc[0]) // STRATUM)
        return pd.DataFrame({"skey": group["skey"], "runs": list(np.cumsum(tree, axis=0).T)})

    stratum = F.floor(F.col("rank") / STRATUM).alias("stratum")
    return sources.select("skey", "rank", "passes", "at1").groupBy(stratum).applyInPandas(split, "skey string, runs array<long>")


def _boundary(rows: DataFrame, digits: str, before: str, sources: DataFrame, suffix: str, sent) -> DataFrame:
    """For each source, the value of ``digits`` at which the words pass the rest of the quota, and the words before it."""
    w = Window.partitionBy("skey").orderBy(digits)
    sums = rows.groupBy("skey", digits).agg(F.sum("size").alias("words")).join(sent(sources.select("skey", "rest", before)), "skey")
    sums = sums.withColumn("ahead", F.col(before) + F.sum("words").over(w) - F.col("words"))
    at = sums.where((F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("words") >= F.col("rest")))
    return at.groupBy("skey").agg(F.min(digits).alias(f"at{suffix}"), F.min("ahead").alias(f"ahead{suffix}"))


def mix(documents: DataFrame, plan: MixPlan = MixPlan(), whole: bool = False, keep: list[str] = ()) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken and shards (of each copy), with the columns in ``keep``.

    A source's taken words sum to its rounded target; the one document where the quota ends gives its first words.
    With ``whole``, that document is taken whole if at least half of it would be, else not.
    """
    return _mix(documents, plan, whole, keep)[0]


def _mix(documents: DataFrame, plan: MixPlan, whole: bool, keep: list[str]) -> tuple[DataFrame, int]:
    """The rows of mix(), and the words of the whole mix."""
    spark = documents.sparkSession
    rows = documents.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("skey"),
        F.regexp_count(text_of(), F.lit(WORD_PATTERN)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(plan.seed), F.col("doc_id").cast("string")).cast("binary")).alias("key"),
        *keep,
    )
    digit = lambda at: F.conv(F.substring("key", at, 3), 16, 10).cast("int")
    rows = rows.withColumns({"block": digit(1), "sub": digit(4)})
    thin = materialize(rows.drop(*keep), "mix-rows")
    rows = rows if keep else thin
    # Sources are a catalogue of feeds; their sizes are the only table that the driver reads.
    found = sorted(thin.groupBy("skey").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r["skey"] == "n", r["skey"]))
    sent = F.broadcast if len(found) <= BROADCAST_SOURCES else lambda df: df
    sizes = [int(r["size"]) for r in found]
    wanted = targets(sizes, plan)
    quota = [int(t + 0.5) for t in wanted]
    passes = [q // s if s else 0 for q, s in zip(quota, sizes)]
    rest = [q - p * s for q, p, s in zip(quota, passes, sizes)]
    schema = "skey string, rank long, source_size long, target double, passes int, rest long, zero long"
    sources = spark.createDataFrame([(r["skey"], i, s, t, p, x, 0) for i, (r, s, t, p, x) in enumerate(zip(found, sizes, wanted, passes, rest))], schema)

    first = _boundary(thin, "block", "zero", sources, "1", sent)
    sources = sources.join(sent(first), "skey", "left").fillna({"at1": -1, "ahead1": 0})
    within = thin.join(sent(sources.select("skey", "at1")), "skey").where("block = at1")
    sources = materialize(sources.join(sent(_boundary(within, "sub", "ahead1", sources, "2", sent)), "skey", "left").fillna({"at2": -1, "ahead2": 0}), "mix-sources")

    sources = materialize(sources.join(sent(_dealt(sources, plan)), "skey"), "mix-dealt")

    at = F.struct("block", "sub")
    rows = rows.join(sent(sources), "skey")
    inside = (F.col("block") == F.col("at1")) & (F.col("sub") == F.col("at2"))
    outer = rows.where(~inside).withColumn("part", F.when(at < F.struct("at1", "at2"), F.col("size")).otherwise(F.lit(0)))
    w = Window.partitionBy("skey").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where(inside).withColumn("part", F.col("rest") - F.col("ahead2") - (F.sum("size").over(w) - F.col("size")))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("part"))))
    if whole:
        edge = edge.withColumn("part", F.when(F.col("part") * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0)))
    out = outer.unionByName(edge)
    # The units (passes of a block) that the tree dealt to shards: of the last one, where the quota ends, a document gives its part.
    on_edge, part = F.col("block") == F.col("at1"), F.col("part")
    units = F.transform(F.sequence(F.lit(0), F.col("passes")), lambda i: i * BLOCKS + F.col("block"))
    dealt = F.when(F.col("size") > 0, F.filter(units, lambda u: u < F.element_at("runs", -1))).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("dealt", dealt)
    drawn = F.when(on_edge & (part == 0), F.slice("dealt", 1, F.greatest(F.size("dealt") - 1, F.lit(0)))).otherwise(F.col("dealt"))
    taken = F.size("dealt") * F.col("size") - F.when(on_edge & (F.size("dealt") > 0), F.col("size") - part).otherwise(0)
    shards = F.transform(drawn, lambda u: F.size(F.filter("runs", lambda x: x <= u)))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), shards.alias("shards"), *keep), sum(quota)


def _number(seed: str) -> int:
    return int.from_bytes(seed.encode(), "big") % (1 << 63)


def mixed_documents(documents: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """The mix itself: whole documents as often as they are taken, in shards, each shard shuffled.

    A shard's documents are put in an order of digests, and pieces of that order of some PIECE_WORDS words are sorted by tasks of their own:
    no task holds a shard, and its pieces one after the other are the shuffled shard.
    """
    columns = documents.columns
    rest = [c for c in columns if c != "doc_id"]
    held = documents.select("doc_id", F.struct(*rest).alias("__rest"), F.col("source"), F.col("text"))
    chosen, words = _mix(held, plan, whole=True, keep=["__rest"])
    copies = chosen.select("doc_id", "__rest", F.posexplode("shards").alias("copy", "shard"))
    pieces = -(-words // (plan.shards * PIECE_WORDS)) or 1
    order = F.shiftrightunsigned(F.xxhash64(F.lit(plan.seed), "doc_id", "copy"), 16)
    placed = copies.withColumn("order", order).withColumn("piece", F.floor(F.col("order") / F.lit(float(1 << 48)) * pieces))
    dealt = placed.repartition(plan.shards * pieces, "shard", "piece").sortWithinPartitions("shard", "piece", "order")
    return dealt.select("doc_id", *[F.col(f"__rest.`{c}`").alias(c) for c in rest]).select(*columns)
