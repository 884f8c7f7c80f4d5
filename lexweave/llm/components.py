"""Connected components of a graph held as a table of edges, by alternating large-star and small-star rounds.

Every round is a pre-aggregated minimum and a join on a node; its result is written to the shared folder, so lineage
stays short and no links reach the driver.  A hub's edges are many rows of one join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links neighbours to the smallest node around: of each node its larger ones (large) or all not larger (small)."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Of the edges (a, b), a row (node, component) for each node but the smallest of its component."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = print_of(edges)
    for _ in range(most_rounds):
        edges = materialize(_star(_star(edges, True), False), "cc")
        after = print_of(edges)
        if before == after:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after
    raise RuntimeError("components did not settle")
