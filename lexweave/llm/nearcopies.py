"""Near copies: SimHash links and MinHash bands find candidates, exact comparison of five-word runs decides.

Two texts are linked if their sets of five-word runs have a Jaccard similarity of SIMILARITY, or if their fingerprints differ in at most
``simhash.DISTANCE`` bits (op3's links, by its multi-index hashing) and their runs, repeats counted as a fingerprint counts them, reach SIMILARITY.

A text's set is its runs of SHINGLE words (64-bit digests).  BANDS keys of ROWS minima each are made of it, and texts that
share a key become candidates; a pair at exactly SIMILARITY shares none with probability (1 - 0.8 ** 5) ** 32 = 3e-6, a closer one
with less.  Candidates of both kinds are only connected (each to the first of its key or fingerprint), never paired, so a common key costs one
row a member.  Every connected set of candidates is then compared exactly, all pairs, in blocks of two chunks of at most CHUNK texts
or so; a set of more members is dealt over pairs of chunks.  Of each block only a spanning forest leaves.

Defined results: null is empty text, and texts without words are one group; texts of less than SHINGLE words are one run;
texts that differ in white space or the case of A-Z alone are one text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import materialize, text_of
from lexweave.llm.components import components
from lexweave.llm.simhash import DISTANCE, fingerprint, near_links

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 5
#: Texts of a candidate set that one side of a block holds.
CHUNK = 256
_SLICE = 4096
_RNG = np.random.default_rng(11)
_PLACES = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * 2 + 1
_TIMES = _RNG.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * 2 + 1
_FLIPS = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)


def shingles(text: str) -> np.ndarray:
    """The different digests of a text's runs of SHINGLE words, sorted."""
    return np.unique(_runs(text))


def _runs(text: str) -> np.ndarray:
    """The digests of a text's runs of SHINGLE words."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x) for x in words], dtype=np.uint64)
    width = min(SHINGLE, len(w))
    h = np.full(len(w) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        h += w[i : len(w) - width + 1 + i] * _PLACES[i]
    h ^= h >> 32
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> 29)


def bands(h: np.ndarray) -> np.ndarray:
    """The keys of a set; they differ from band to band."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    part = (h >> 32).astype(np.uint32)
    for at in range(0, len(part), _SLICE):
        low = np.minimum(low, ((part[None, at : at + _SLICE] ^ _FLIPS) * _TIMES).min(axis=1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def _signed(documents: DataFrame) -> DataFrame:
    """doc_id, raw (of the text as it is), node (of its words), fp (its fingerprint) and keys of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("raw", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            node = [xxhash.xxh64_intdigest(b" ".join(x.encode("utf-8", "replace").lower().split())) - (1 << 63) for x in texts]
            fp = np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64)
            keys = [bands(shingles(x)) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("raw"), text_of().alias("text"))
    return materialize(rows.mapInArrow(run, "doc_id long, raw long, node long, fp long, keys array<long>"), "near-rows")


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, an edge from every node to the first of its key."""
    last, hub = None, 0
    for batch in batches:
        key, node = (batch.column(n).to_numpy() for n in ("key", "node"))
        if not len(key):
            continue
        new = np.concatenate(([last is None or key[0] != last], key[1:] != key[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = np.where(at >= 0, node[at], hub)
        last, hub = key[-1], first[-1]
        apart = first != node
        yield pa.RecordBatch.from_pydict({"a": node[apart], "b": first[apart]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


class Member(NamedTuple):
    node: int
    chunk: int
    kinds: np.ndarray  # digests of the different runs
    counts: np.ndarray  # of each
    fp: int


def forest_of(members: list[Member]) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the linked pairs.  Two chunks: pairs across alone."""
    members = [m for m in members if len(m.kinds)]
    if len(members) < 2:
        return []
    sizes = np.array([len(m.kinds) for m in members])
    wholes = np.array([m.counts.sum() for m in members])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    kinds, flat = np.unique(np.concatenate([m.kinds for m in members]), return_inverse=True)
    counts = np.concatenate([m.counts for m in members])
    chunk = np.array([m.chunk for m in members])
    fp = np.array([m.fp for m in members], dtype=np.int64).view(np.uint64)
    across = chunk.min() != chunk.max()
    inside, group, out = np.zeros(len(kinds), dtype=np.int64), np.arange(len(members)), []
    for i in range(len(members)):
        # A pair is seen from its later member, or from the higher chunk's; what is connected is not compared again.
        wanted = (group != group[i]) & ((chunk < chunk[i]) if across else (np.arange(len(members)) < i))
        if not wanted.any():
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        inside[own] = members[i].counts
        held = inside[flat]
        both = np.add.reduceat((held > 0).astype(np.int64), starts)
        # both / union >= 4 / 5, in integers
        linked = both * 9 >= 4 * (sizes + sizes[i])
        near = wanted & ~linked & (np.bitwise_count(fp ^ fp[i]) <= DISTANCE)
        if near.any():
            linked |= near & (np.add.reduceat(np.minimum(held, counts), starts) * 9 >= 4 * (wholes + wholes[i]))
        inside[own] = 0
        for j in np.flatnonzero(wanted & linked).tolist():
            if group[j] != group[i]:
                out.append((members[i].node, members[j].node))
                group[group == group[j]] = group[i]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by component and block, the forests."""
    rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("component", "block", "node", "own", "fp", "text"))))
    for _, part in groupby(rows, key=lambda r: r[:2]):
        members = {node: Member(node, own, *np.unique(_runs(text), return_counts=True), fp) for _, _, node, own, fp, text in part}
        if found := forest_of(list(members.values())):
            a, b = zip(*found)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _fingerprint_links(firsts: DataFrame) -> DataFrame:
    """Edges of nodes (node, fp) whose fingerprints link: a fingerprint's first node stands for it, its other nodes are linked to that."""
    nodes = materialize(firsts.groupBy("fp").agg(F.min("node").alias("node")), "near-fingerprints")
    same = firsts.join(nodes.select("fp", F.col("node").alias("b")), "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    return near_links(nodes.select("fp", "node")).unionByName(same)


def _first_rows(documents: DataFrame) -> DataFrame:
    """component, row (no_id, doc_id, raw): the first row of every different text, with its group of near copies."""
    signed = _signed(documents)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw")
    firsts = materialize(signed.groupBy("node").agg(F.min(row).alias("row"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "near-nodes")
    entries = firsts.select("node", F.explode("keys").alias("key"))
    banded = entries.repartition("key").sortWithinPartitions("key").mapInArrow(_connect, "a long, b long")
    candidates = components(banded.unionByName(_fingerprint_links(firsts)))
    roots = candidates.select(F.col("component").alias("node"), "component").distinct()
    sets = materialize(candidates.unionByName(roots).join(firsts.select("node", "fp", "row"), "node"), "near-sets")

    chunks = sets.groupBy("component").count().select("component", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    dealt = sets.join(chunks, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    texts = documents.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64(text_of()).alias("__raw"), text_of().alias("text"))
    dealt = texts.join(dealt, F.col("__id").eqNullSafe(F.col("row.doc_id")) & (F.col("__raw") == F.col("row.raw")))
    blocks = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least("own", j) * F.col("chunks") + F.greatest("own", j))
    dealt = dealt.select("component", F.explode(blocks).alias("block"), "node", "own", "fp", "text")
    links = dealt.repartition("component", "block").sortWithinPartitions("component", "block").mapInArrow(_compare, "a long, b long")
    found = components(links)
    return firsts.join(found, "node", "left").select(F.coalesce("component", "node").alias("component"), "row")


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """One row of each group of near copies: of the smallest doc_id, then of the smallest text digest.

    Rows without a doc_id take part like others, after all that have one.  Rows that repeat a doc_id are told apart by their
    texts; of rows that repeat both, one is kept.
    """
    kept = _first_rows(documents).groupBy("component").agg(F.min("row").alias("row")).select(F.col("row.doc_id").alias("__kept_id"), F.col("row.raw").alias("__kept_raw"))
    rows = documents.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__raw", F.xxhash64(text_of()))
    rows = rows.join(kept, F.col("__id").eqNullSafe(F.col("__kept_id")) & (F.col("__raw") == F.col("__kept_raw")), "left_semi")
    return rows.dropDuplicates(["__id", "__raw"]).select(*documents.columns)
