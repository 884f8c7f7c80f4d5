"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit where over half of the shingles' XXH64 values (seed 42) have it.  Of two fingerprints at 4 or
fewer differing bits, cut into segments of 22, 21 and 21 bits, either the first or second segments differ in at most
one bit or the third ones are equal (else at least 2 + 2 + 1 bits would differ).  Every distinct fingerprint enters three tables by its
segments; the Hamming balls of radius 1 around the first two segments are enumerated downwards (a set bit
cleared), as of two segments that differ in one bit, the one with the bit reaches the other.  Matches are verified on
the complete distance.  A key's members are compared in blocks, and only a spanning forest of each block leaves, never
all pairs; a key with a crowd of table rows or ball members is dealt over pairs of chunks, so no task holds a whole hot key.

Defined results: null is empty text; texts of less than four words are one shingle; no words give fingerprint zero,
linked like any other; equal rows share a fingerprint, and rows that repeat an id with other texts have their own; rows without an id take
part, and a group without any id has a null component; a component is its smallest id, so ties cannot be; texts of any length are
read whole, in slices; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import materialize, text_of
from lexweave.llm.components import components

SEGMENTS = ((42, 22, 1), (21, 21, 1), (0, 21, 0))  # shift, bits, radius
DISTANCE = 4
#: Members of a key that one block compares.
BLOCK = 2048
_CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = 4) -> int:
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed=42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    hashed, view = xxhash.xxh64_intdigest, memoryview(joined)
    counts = np.zeros(64, dtype=np.int64)
    for low in range(0, n, _CHUNK):
        high = min(n, low + _CHUNK)
        spans = zip(starts[low:high].tolist(), ends[low + shingle - 1 : high + shingle - 1].tolist())
        h = np.array([hashed(view[a:b], 42) for a, b in spans], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x) for x in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


def _entries(nodes: DataFrame) -> DataFrame:
    """Table entries (probe false) and ball members (probe true) of every fingerprint: key, probe, fp, node."""
    parts = []
    for k, (shift, bits, radius) in enumerate(SEGMENTS):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))
        tag = F.lit(k << 32)
        ball = [F.struct((value + tag).alias("key"), F.lit(False).alias("probe"))]
        if radius:
            ball += [F.when(value.bitwiseAND(F.lit(1 << i)) != 0, F.struct((value - (1 << i) + tag).alias("key"), F.lit(True).alias("probe"))) for i in range(bits)]
        parts += ball
    return nodes.select(F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("e"), "fp", "node").select("e.key", "e.probe", "fp", "node")


def _forest(fp: np.ndarray, node: np.ndarray, probe: np.ndarray, seen: dict[int, int]) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the linked members of one key."""

    def root(x: int) -> int:
        while seen[x] != x:
            seen[x] = seen[seen[x]]
            x = seen[x]
        return x

    seen.clear()
    seen.update((x, x) for x in node.tolist())
    out = []
    table = np.flatnonzero(~probe)
    for low in range(0, len(fp), 512):
        rows = slice(low, low + 512)
        near = np.bitwise_count(fp[rows, None] ^ fp[None, table]) <= DISTANCE
        near &= node[rows, None] != node[None, table]
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            a = int(node[low + i])
            for b in node[table[near[i]]].tolist():
                x, y = root(a), root(b)
                if x != y:
                    seen[max(x, y)] = min(x, y)
                    out.append((max(a, b), min(a, b)))
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and block, the forests; a key that a batch cuts is carried over."""

    def emit(part: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        same = (part["key"][1:] == part["key"][:-1]) & (part["block"][1:] == part["block"][:-1])
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        ends = np.concatenate((starts[1:], [len(part["key"])]))
        found, seen = [], {}
        tables = np.concatenate(([0], np.cumsum(~part["probe"])))
        many = (ends - starts > 1) & (tables[ends] > tables[starts])
        for s, e in zip(starts[many].tolist(), ends[many].tolist()):
            found += _forest(part["fp"][s:e], part["node"][s:e], part["probe"][s:e], seen)
        if found:
            a, b = zip(*found)
            return pa.RecordBatch.from_pydict({"a": a, "b": b}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        return None

    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        part = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "block", "probe", "fp", "node")}
        part["fp"], part["probe"] = part["fp"].view(np.uint64), part["probe"].astype(bool)
        if held is not None:
            part = {n: np.concatenate((held[n], part[n])) for n in part}
        if not len(part["key"]):
            continue
        last = (part["key"] == part["key"][-1]) & (part["block"] == part["block"][-1])
        cut = int(np.argmax(last))
        held = {n: x[cut:] for n, x in part.items()}
        if cut and (out := emit({n: x[:cut] for n, x in part.items()})) is not None:
            yield out
    if held is not None and (out := emit(held)) is not None:
        yield out


def near_links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes that connect all fingerprints at DISTANCE or less; nodes: fp (distinct), node."""
    entries = _entries(nodes)
    segments = F.array(*[F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << n) - 1)) + F.lit(k << 32) for k, (s, n, _) in enumerate(SEGMENTS)])
    hot = nodes.select(F.explode(segments).alias("key")).groupBy("key").count().where(F.col("count") > BLOCK)
    # The ball members of a hot key's fingerprints crowd the keys below it, so those are cut too; other keys have at most 23 * BLOCK rows.
    value = F.col("key").bitwiseAND(F.lit((1 << 32) - 1))
    wide = F.element_at(F.array(*[F.lit(n if radius else 0) for _, n, radius in SEGMENTS]), (F.shiftright("key", 32) + 1).cast("int"))
    bits = F.transform(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: i < wide), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    below = hot.select(F.explode(F.filter(bits, lambda x: value.bitwiseAND(x) != 0)).alias("bit"), "key", "count").select((F.col("key") - F.col("bit")).alias("key"), F.lit(0).cast("long").alias("tables"), F.col("count").alias("members"))
    hot = hot.select("key", F.col("count").alias("tables"), F.col("count").alias("members")).unionByName(below)
    hot = hot.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.sum("tables") / BLOCK)).cast("int").alias("down"), F.ceil(F.sum("members") / BLOCK).cast("int").alias("across"))
    rows = entries.join(hot, "key", "left").withColumns({"down": F.coalesce("down", F.lit(1)), "across": F.coalesce("across", F.lit(1))})
    # A cut key's table is dealt over ``down`` chunks, and all that is compared with it over ``across``: block = table chunk * across + chunk.
    own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    as_table = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda j: F.struct((own("down") * F.col("across") + j).alias("block"), F.lit(False).alias("probe")))
    as_probe = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: F.struct((i * F.col("across") + own("across")).alias("block"), F.lit(True).alias("probe")))
    one = F.array(F.struct(F.lit(0).alias("block"), F.col("probe").alias("probe")))
    dealt = F.when(F.col("down") * F.col("across") == 1, one).when(F.col("probe"), as_probe).otherwise(F.concat(as_table, as_probe))
    rows = rows.select("key", F.explode(dealt).alias("d"), "fp", "node").select("key", "d.block", "d.probe", "fp", "node")
    return rows.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_links, "a long, b long")


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """The stage's choice, which ``nearcopies`` makes of these links and others, by exact comparison."""
    from lexweave.llm import nearcopies

    return nearcopies.one_of_each_group(documents)


def near_groups(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id (smallest doc_id reachable over links)."""
    docs = materialize(fingerprints(documents), "simhash")
    # A fingerprint is its own node, so links do not depend on ids; a component's smallest id is found afterwards.
    nodes = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.col("fp")), "simhash-nodes")
    found = components(near_links(nodes.select("fp", "node")))
    groups = nodes.join(found, "node", "left").select("fp", "doc_id", F.coalesce("component", "node").alias("component"))
    smallest = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = groups.join(smallest, "component").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
