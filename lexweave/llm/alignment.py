"""Two tokenizers' tokens of the same texts aligned by their byte offsets, as windows and joins over the shapes of units.

A block of texts becomes numbers of units, and each distinct unit of the block the ids of its A and B tokens.  A unit begins where both
tokenizers begin a token (``units.parts``), so what is said of its tokens holds wherever it occurs.  How tokens overlap depends on their byte
lengths alone, a unit's shape: the alignment is done once for each shape of a block, and units take it with their own ids.  The coded table
is bucketed by block, so that all that follows but pair counts is windowed, gathered and joined without moving it:

- a shape's tokens are exploded with their positions, and windowed cumulative lengths give where each begins and ends;
- A and B meet in an equi-join on shape and offset (where one token ends and the next begins), written as its merge: a window over both sides'
  offsets, in which equal ones are neighbours, as an outer join would be shuffled; offsets of both are cuts, and the running count of cuts
  is the group's number;
- two tokens overlap exactly once between two neighbouring offsets, so every offset, with the last A and B token that begin there or before,
  is a link: no group is multiplied out, however long;
- documents, units and layouts of a block meet in a cogroup, which puts ids in the layouts' places and counts the block's distinct (document,
  pair) once each; the counts of all blocks are added up, a window finds each A id's highest, and a second cogroup adds them up by document.

Frequent units, pairs and copies are one entry in a block of about ``block`` bytes, so no key is hot; a pair's count has a row for each block.

Defined results: texts that are null or empty, or which a tokenizer does not give back byte for byte (U+2581 is a blank to B), have no
tokens: zeros and an empty digest; special tokens' strings are plain text; every row is a document, also one that repeats an id or
another row; a text without blanks is one unit, whatever its length; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.bpe import blocks
from lexweave.llm.common import materialize, scratch_path, text_of
from lexweave.llm.packing import Coder, default_tokenizer, shared_coder
from lexweave.llm.units import byte_vocabulary, numbering, parts

#: Bytes of text that share one dictionary of units, which meet in a task.
BLOCK = 8 << 20
#: More buckets than these are not made: a task then has several blocks and may spill.
MOST_BUCKETS = 50_000
#: Units that the libraries encode at once: their results are large until ids are taken from them.
SLICE = 4096
#: Blocks that a task can number.
_BLOCKS = 1 << 20
#: Links of documents that are made distinct at once.
LINKS = 1 << 20
CODED = "block long, row int, doc_id long, parts array<int>, slice int, shapes array<int>, a array<int>, b array<int>, shape int, a_bytes array<int>, b_bytes array<int>"
NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
ALIGNED = f"block long, row int, doc_id long, parts array<int>, {', '.join(f'{c} long' for c in NUMBERS)}, groups_sha256 string, sizes array<int>, linked array<int>, number int, pair long, n long"
SUMMED = f"doc_id long, {', '.join(f'{c} long' for c in NUMBERS)}, n_best long, count_sum long, groups_sha256 string"


def default_pieces() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Tokenizers:
    """A byte-level BPE file (A) and a sentencepiece model with byte fallback (B)."""

    def __init__(self, a: str, b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        coder = shared_coder(a)
        self.fast = coder.fast.encode_ordinary if coder.fast else lambda text: self.a.encode(text, add_special_tokens=False).ids
        self.a_tokens = byte_vocabulary(a).tokens
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{b} has pieces that reach over the beginning of a word")
        self.b_tokens = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id("▁")
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], dtype=np.int32) for x in (self.a_tokens, self.b_tokens))

    def _a_ids(self, unit: str) -> list[int]:
        # tiktoken gives the same ids faster, but for very long words, on which it is slow.
        return self.fast(" " + unit) if len(unit) < Coder.RUN else self.a.encode(" " + unit, add_special_tokens=False).ids

    def encode(self, units: list[str]) -> tuple[pa.ListArray, pa.ListArray, np.ndarray]:
        """Of units without the blank before each: A ids, B ids, and whether both are the unit's bytes."""
        a, b, exact = [], [], []
        for low in range(0, len(units), SLICE):
            some = units[low : low + SLICE]
            own_a = list(map(self._a_ids, some))
            # A blank alone, at the end of a text: B would add its own to no text at all.
            own_b = [x if u else [self.blank] for u, x in zip(some, self.b.encode(some, num_threads=1))]
            a.append(_lists(own_a))
            b.append(_lists(own_b))
            exact.append(_exact(some, a[-1], self.a_tokens, self.a_sizes) & _exact(some, b[-1], self.b_tokens, self.b_sizes))
        return pa.concat_arrays(a), pa.concat_arrays(b), np.concatenate(exact)


def _exact(units: list[str], ids: pa.ListArray, tokens: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Whether each unit, with the blank before it, is its tokens' bytes."""
    values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
    whole = (" " + " ".join(units)).encode()
    lengths = np.fromiter(map(len, units) if len(whole) == sum(map(len, units)) + len(units) else (len(u.encode()) for u in units), np.int64, len(units)) + 1
    if np.array_equal(_sums(sizes[values], ends), lengths) and b"".join(map(tokens.__getitem__, values.tolist())) == whole:
        return np.ones(len(units), bool)
    return np.array([b"".join(map(tokens.__getitem__, x)) == b" " + u.encode() for u, x in zip(units, ids.to_pylist())], bool)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each list's values."""
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[offsets])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ..., size of them, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


@lru_cache(maxsize=1)
def _tokenizers(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


def _lists(rows: list[list[int]]) -> pa.ListArray:
    sizes = np.fromiter(map(len, rows), np.int32, len(rows))
    values = np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


def _rows(schema: str, size: int, **columns) -> pa.RecordBatch:
    """Rows of a schema; the columns that are not given are null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, kinds[kind]) for c, kind in fields], schema=pa.schema([(c, kinds[kind]) for c, kind in fields]))


def _numbers(n: int) -> pa.Array:
    return pa.array(np.arange(n, dtype=np.int32))


def _repeated(x: int, n: int) -> pa.Array:
    return pa.array(np.full(n, x), pa.int64())


def _coded(ids: pa.Array, texts: list[str | None], block: int, t: Tokenizers) -> Iterator[pa.RecordBatch]:
    """A block's documents, units and shapes as batches of CODED."""
    units = numbering()
    number = units.__getitem__
    rows = [list(map(number, parts(x))) if x else [] for x in texts]
    if units:
        la, lb, exact = t.encode(list(units))
        wrong = set(np.flatnonzero(~exact).tolist())
        if wrong:
            rows = [[] if not wrong.isdisjoint(x) else x for x in rows]
    n, m = len(rows), len(units)
    yield _rows(CODED, n, block=_repeated(block, n), row=_numbers(n), doc_id=ids, parts=_lists(rows))
    if m:
        shapes = numbering()
        (a, ends_a), (b, ends_b) = ((x.values.to_numpy(), x.offsets.to_numpy()) for x in (la, lb))
        lengths_a, lengths_b = t.a_sizes[a].tobytes(), t.b_sizes[b].tobytes()
        cut = lambda x, ends: map(x.__getitem__, map(slice, (4 * ends[:-1]).tolist(), (4 * ends[1:]).tolist()))
        of = np.fromiter(map(shapes.__getitem__, zip(cut(lengths_a, ends_a), cut(lengths_b, ends_b))), np.int32, m)
        at = np.append(np.arange(0, m, SLICE), m)
        listed = lambda x, ends: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x))
        k = len(at) - 1
        yield _rows(CODED, k, block=_repeated(block, k), slice=_numbers(k), shapes=listed(of, at), a=listed(a, ends_a[at]), b=listed(b, ends_b[at]))
        k = len(shapes)
        sizes = lambda i: listed(np.frombuffer(b"".join(x[i] for x in shapes), np.int32), np.cumsum([0, *(len(x[i]) // 4 for x in shapes)]))
        yield _rows(CODED, k, block=_repeated(block, k), shape=_numbers(k), a_bytes=sizes(0), b_bytes=sizes(1))


@contextmanager
def sorted_gathering(spark: SparkSession) -> Iterator[None]:
    """What a window has sorted is gathered as it comes; the session's own setting returns at the end."""
    wanted = {"spark.sql.execution.replaceHashWithSortAgg": "true"}
    own = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in own.items():
            spark.conf.set(name, value)


def bucketed(df: DataFrame, name: str, n: int) -> DataFrame:
    """The table written to the shared folder in n buckets of its blocks, and read as such."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", scratch_path(spark, name)).bucketBy(n, "block").saveAsTable(table)
    return spark.table(table)


def coded(documents: DataFrame, a: str | None = None, b: str | None = None, block: int = BLOCK) -> DataFrame:
    """CODED: a row for each document (row, doc_id, parts), for SLICE distinct units of a block (slice, their shapes and ids) and for each of its shapes."""
    paths = a or default_tokenizer(), b or default_pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, first = _tokenizers(*paths), TaskContext.get().partitionId() * _BLOCKS
        for i, rows in enumerate(blocks(batches, 1, block)):
            yield from _coded(rows.column(0), rows.column(1).to_pylist(), first + i, t)

    return documents.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, CODED)


def overlaps(shapes: DataFrame) -> DataFrame:
    """Of shapes (block, shape, a_bytes, b_bytes) a row for each token: start, is_b, pos (B's after A's), part (group), and link (places in a and b, a * 2^32 + b) where one begins."""
    tokens = shapes.select("block", "shape", F.size("a_bytes").alias("n"), F.posexplode(F.concat("a_bytes", "b_bytes")).alias("pos", "bytes"))
    tokens = tokens.withColumn("is_b", F.col("pos") >= F.col("n"))
    order = Window.partitionBy("block", "shape", "is_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tokens = tokens.select("block", "shape", "is_b", "pos", "n", (F.sum("bytes").over(order) - F.col("bytes")).alias("start"))
    # Sorted by offset, equal ones of A and B are neighbours, A's first: the two sides meet as in a merge join.
    met = Window.partitionBy("block", "shape").orderBy("start", "is_b")
    follows = F.lead("start").over(met)
    tokens = tokens.withColumn("joined", F.coalesce(follows == F.col("start"), F.lit(False)))
    running = met.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda b: F.last(F.when(F.col("is_b") == b, F.col("pos").cast("long")), ignorenulls=True).over(running)
    link = F.when(~F.col("joined"), F.shiftleft(last(False), 32) + last(True) - F.col("n"))
    return tokens.select("block", "shape", "start", "is_b", "pos", F.sum(F.col("joined").cast("int")).over(running).alias("part"), link.alias("link"))


def layouts(tokens: DataFrame) -> DataFrame:
    """block, shape, n_a, n_b, n_groups, written (the groups as text, with %d for ids), places (of the ids in it, pos) and links.

    The tokens arrive in the order of their shapes, so this gathers a shape at a time.
    """
    n_b = F.sum(F.col("is_b").cast("int"))
    rows = tokens.groupBy("block", "shape").agg(F.sort_array(F.collect_list(F.struct("part", "is_b", "start", "pos"))).alias("tokens"), (F.count("*") - n_b).alias("n_a"), n_b.alias("n_b"), F.max("part").alias("n_groups"), F.collect_list("link").alias("links"))
    before = lambda i: F.get("tokens", i - 1)
    apart = lambda x, i: F.when(i == 0, "%d").when(before(i)["part"] != x["part"], ";%d").when(before(i)["is_b"] == x["is_b"], ",%d").otherwise("|%d")
    return rows.select("block", "shape", "n_a", "n_b", "n_groups", F.array_join(F.transform("tokens", apart), "").alias("written"), F.col("tokens.pos").alias("places"), "links")


def _lists_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as values and offsets."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(), offsets - offsets[0]


def _numbers_of(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _where(table: pa.Table, column: str) -> pa.Table:
    """The rows that have the column, in its order."""
    return table.filter(table.column(column).is_valid()).sort_by(column)


def _documents_with(index: np.ndarray, starts: np.ndarray, sizes: np.ndarray, units: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """For each of k pairs the number of documents that have it; a unit's pairs are ``index`` from its start."""
    n = np.zeros(k, np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes[units])))[offsets]
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + LINKS, side="right")) - 1)
        used = units[offsets[low] : offsets[high]]
        rows = np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1]))
        if high == low + 1:
            used = np.unique(used)
            rows = np.zeros(len(used), np.int64)
        held = np.unique(np.repeat(rows * k, sizes[used]) + index[_spread(starts[used], sizes[used])])
        n += np.bincount(held % k, minlength=k)
        low = high
    return n


def _aligned(key: tuple, coded: pa.Table, found: pa.Table) -> pa.Table:
    """A block's documents, its units' links as numbers of its pairs, and its pairs, as ALIGNED."""
    block, docs, made = key[0].as_py(), _where(coded, "row"), _where(coded, "slice")
    n = len(docs)
    units, offsets = _lists_of(docs.column("parts"))
    found = found.sort_by("shape")
    n_a, n_b, n_groups = _numbers_of(found, "n_a", "n_b", "n_groups")
    (shape, _), (a, _), (b, _) = (_lists_of(made.column(c)) for c in ("shapes", "a", "b")) if len(made) else [(np.zeros(0, np.int32), None)] * 3
    (places, place), (links, link) = (_lists_of(found.column(c)) for c in ("places", "links")) if len(found) else [(np.zeros(0, np.int64), np.zeros(1, np.int32))] * 2
    of_a, of_b = n_a[shape], n_b[shape]
    first_a, first_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b

    sizes = of_a + of_b
    at, own = places[_spread(place[shape], sizes)], np.repeat(np.arange(len(shape)), sizes)
    ids = np.concatenate((a, b))[at + np.where(at < of_a[own], first_a[own], len(a) + (first_b - of_a)[own])].tolist()
    ends = np.cumsum(sizes).tolist()
    written = found.column("written").to_pylist()
    text = [written[s] % tuple(ids[x:y]) for s, x, y in zip(shape.tolist(), [0, *ends], ends)].__getitem__
    spans = zip(offsets[:-1].tolist(), offsets[1:].tolist())
    numbered = units.tolist()
    digests = [hashlib.sha256(";".join(map(text, numbered[x:y])).encode()).hexdigest() if y > x else "" for x, y in spans]

    sizes = np.diff(link)[shape]
    at, own = links[_spread(link[shape], sizes)], np.repeat(np.arange(len(shape)), sizes)
    pairs, index = np.unique((a[first_a[own] + (at >> 32)].astype(np.int64) << 32) + b[first_b[own] + (at & 0xFFFFFFFF)], return_inverse=True)
    held = _documents_with(index, np.cumsum(sizes) - sizes, sizes, units, offsets, len(pairs)) if len(units) else np.zeros(len(pairs), np.int64)

    sums = {c: pa.array(_sums(x[units], offsets)) for c, x in zip(NUMBERS, (of_a, of_b, n_groups[shape], sizes))}
    out = [_rows(ALIGNED, n, block=_repeated(block, n), row=docs.column("row").combine_chunks(), doc_id=docs.column("doc_id").combine_chunks(), parts=docs.column("parts").combine_chunks(), groups_sha256=pa.array(digests, pa.string()), **sums)]
    if len(units):
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int32)))
        some = np.flatnonzero(held).astype(np.int32)
        k = len(some)
        out.append(_rows(ALIGNED, 1, block=_repeated(block, 1), sizes=one(sizes), linked=one(index)))
        out.append(_rows(ALIGNED, k, block=_repeated(block, k), number=pa.array(some), pair=pa.array(pairs[some]), n=pa.array(held[some])))
    return pa.Table.from_batches(out)


def _summed(key: tuple, aligned: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's documents with n_best and count_sum."""
    docs, made = _where(aligned, "row"), aligned.filter(aligned.column("sizes").is_valid())
    units, offsets = _lists_of(docs.column("parts"))
    number, count, best = _numbers_of(counts, "number", "count", "best")
    own = {c: pa.array(np.zeros(len(docs), np.int64)) for c in ("n_best", "count_sum")}
    if len(made):
        (sizes, _), (linked, _) = (_lists_of(made.column(c)) for c in ("sizes", "linked"))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        for c, values in (("n_best", best), ("count_sum", count)):
            # Pairs of units in no document that has tokens are not counted, nor asked for.
            of = np.zeros(int(linked.max()) + 1, np.int64)
            of[number] = values
            own[c] = pa.array(_sums(_sums(of[linked], ends)[units], offsets))
    return pa.table({"doc_id": docs.column("doc_id")} | {c: docs.column(c) for c in NUMBERS} | own | {"groups_sha256": docs.column("groups_sha256")})


def pair_counts(local: DataFrame) -> DataFrame:
    """Of each block's pairs (block, number, pair, n): block, number, count (documents of all blocks that hold it linked), best (whether no pair of its A id has more)."""
    counts = local.groupBy("pair").agg(F.sum("n").alias("count"))
    best = Window.partitionBy(F.shiftright("pair", 32))
    counts = counts.withColumn("best", (F.col("count") == F.max("count").over(best)).cast("long"))
    return local.select("block", "number", "pair").join(counts, "pair").select("block", "number", "count", "best")


def align(documents: DataFrame, a: str | None = None, b: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document, written when this returns."""
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length(text_of())).alias("bytes")).first()["bytes"] or 0
    # Twice as many as blocks, as several may fall into one.
    n = min(max(-(-2 * size // block), int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_BUCKETS)
    with sorted_gathering(spark):
        both = bucketed(coded(documents, a, b, block), "coded", n)
        found = layouts(overlaps(both.where("shape IS NOT NULL").select("block", "shape", "a_bytes", "b_bytes")))
        texts = both.where("shape IS NULL").select("block", "row", "doc_id", "parts", "slice", "shapes", "a", "b")
        aligned = bucketed(texts.groupBy("block").cogroup(found.withColumnRenamed("block", "at").groupBy("at")).applyInArrow(_aligned, ALIGNED), "aligned", n)
        counts = pair_counts(aligned.where("pair IS NOT NULL").select("block", "number", "pair", "n"))
        rows = aligned.where("pair IS NULL").drop("number", "pair", "n")
        return materialize(rows.groupBy("block").cogroup(counts.withColumnRenamed("block", "at").groupBy("at")).applyInArrow(_summed, SUMMED), "alignment").select("doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256")
