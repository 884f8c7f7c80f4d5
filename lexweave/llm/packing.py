"""Shortest-pack-first packing over the histogram of lengths.

Documents become token ids with a closing id 0 and are cut into pieces of at most ``length`` ids.  The histogram of the
pieces' lengths (at most ``length`` bins, so the only thing that the driver sees) is packed longest first: each length
goes to the packs with the most room (the shortest packs) that hold it, whole counts of equal packs at a time, and a
pattern is a multiset of lengths with the number of packs that follow it.  Patterns are then joined back to the pieces by their
rank among pieces of equal length.  Ranks are counted in BUCKETS buckets per length, so no length is one task's.

Defined results: null is empty text, which is the single id 0; rows that repeat a doc_id are packed as documents of
their own; an empty table has no sequences.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import materialize, text_of

LENGTH = 1024
BUCKETS = 4096
_SPACES = re.compile(r"\s{1000}")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def pack_histogram(histogram: dict[int, int], size: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) with their numbers of packs."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            # The emptiest packs of those that are open; an empty pack only where none has room.
            best = max((r for r, packs in room.items() if packs and r >= length), default=None)
            if best is None:
                each = size // length
                if left >= each:
                    room[size - each * length].append(((length,) * each, left // each))
                if left % each:
                    room[size - left % each * length].append(((length,) * (left % each), 1))
                break
            pattern, n = room[best].pop()
            used = min(n, left)
            if n > used:
                room[best].append((pattern, n - used))
            room[best - length].append((pattern + (length,), used))
            left -= used
    return sorted((p, n) for packs in room.values() for p, n in packs)


class Coder:
    """Token ids as the tokenizers library gives them for the file at ``path``, with the file's added tokens recognised.

    The file is a byte-level BPE whose ids follow the order of its merges, so tiktoken's merge by rank gives the same ids
    several times faster.  Texts with an added token, or with very long runs, on which tiktoken's pattern and merge are slow, go to tokenizers.
    """

    # Fixed value: the pre-tokenizer's pattern that byte-level BPE files refer to by use_regex.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    RUN = 1000

    def __init__(self, path: str):
        import json

        import tiktoken

        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            kept = json.load(f)
        vocabulary, merges = kept["model"]["vocab"], kept["model"]["merges"]
        self.size = 1 + max([*vocabulary.values(), *(t["id"] for t in kept["added_tokens"])])
        plain = kept["normalizer"] is None and kept["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        self.added = [t["content"] for t in kept["added_tokens"]]
        self.fast = None
        if plain and not kept["model"]["ignore_merges"] and all(a < b for a, b in zip(made, made[1:])):
            visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
            ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in self.added}
            self.fast = tiktoken.Encoding("pieces", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        slow = self.fast is None or any(a in text for a in self.added)
        if slow or max(map(len, text.split()), default=0) > self.RUN or _SPACES.search(text):
            if self.tokenizer is None:
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.path)
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=1)
def shared_coder(path: str) -> Coder:
    """One per Python worker, however many tasks it runs."""
    return Coder(path)


def pieces(documents: DataFrame, tokenizer: str | None = None, size: int = LENGTH) -> DataFrame:
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = shared_coder(path)
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array(coder.ids(text) + [0], dtype="<u4")
                for s in range(0, len(ids), size):
                    piece = ids[s : s + size]
                    rows.append((doc, s, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, PIECES)


def pack(documents: DataFrame, tokenizer: str | None = None, size: int = LENGTH) -> DataFrame:
    """A row for each piece: PIECES, sequence_id, offset."""
    bucket = F.pmod(F.xxhash64("doc_id", "start"), F.lit(BUCKETS)).cast("int")
    found = materialize(pieces(documents, tokenizer, size).withColumn("bucket", bucket), "pieces")
    counts = found.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket")
    counts = materialize(counts.select("length", "bucket", "n", (F.sum("n").over(before) - F.col("n")).alias("ahead")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    # By length: the ranks from which a pattern takes them, and where it puts them.
    spans: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)  # first rank, times, first sequence, offset, length
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in pack_histogram(histogram, size):
        offset = 0
        for length in dict.fromkeys(pattern):
            times = pattern.count(length)
            spans[length].append((taken[length], times, sequence, offset, length))
            taken[length] += times * n
            offset += times * length
        sequence += n
    tables = {k: np.array(v, dtype=np.int64) for k, v in spans.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for k in np.unique(length).tolist():
                of, t = length == k, tables[k]
                row = t[np.searchsorted(t[:, 0], rank[of], side="right") - 1]
                nth = rank[of] - row[:, 0]
                at[of] = row[:, 2] + nth // row[:, 1]
                offset[of] = row[:, 3] + nth % row[:, 1] * k
            keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(at), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = found.withColumn("nth", F.row_number().over(within)).join(counts.select("length", "bucket", "ahead"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("ahead") + F.col("nth") - 1).cast("long").alias("rank"))
    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
