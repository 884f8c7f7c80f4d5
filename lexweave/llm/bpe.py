"""Byte-level BPE encoding and decoding by an index of pair occurrences.

A task takes its texts in blocks of about ``block`` bytes.  A block's texts become numbers of units (``units.parts``), its
distinct units pre-tokens, and its distinct pre-tokens one array of byte ids with links to the left and right neighbours.  An index maps
every pair that has a rank to all its positions in the block.  A heap holds the active ranks: the lowest is taken, all its positions
are merged at once (from the left where a pair overlaps itself), and the pairs that this makes enter the lists of their ranks.
Merged pre-tokens go back to units and units to texts, so frequent words cost a look-up.  Decoding joins the ids' bytes again.

Defined results: null is empty text, which has no ids; the file's added tokens are recognised inside texts as one id each; rows
that repeat an id or a text are rows of their own; a text of any length, also without blanks, is encoded whole; other columns are ignored
(with keep: carried); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lexweave.llm.common import text_of
from lexweave.llm.packing import Coder, default_tokenizer
from lexweave.llm.units import ByteVocabulary, byte_vocabulary, numbering, parts

#: Bytes of text that share one pair index.
BLOCK = 32 << 20
_WORDS = regex.compile(Coder.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class PairIndex:
    """The merges of a vocabulary, applied to many words at once."""

    def __init__(self, vocabulary: ByteVocabulary):
        self.size = len(vocabulary.tokens)
        self.left, self.right, self.made = vocabulary.merges.T
        keys = self.left * self.size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.bytes = vocabulary.bytes

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for those without."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.order[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in one array, and where each word's ids begin and end."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(words) else 0
        if not n or not len(self.keys):
            ids = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
            return ids, np.concatenate(([0], ends))
        # One place more than bytes: the neighbour of a word's outer ones.
        symbol = np.append(self.bytes[np.frombuffer(b"".join(words), np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        filled = ends[lengths > 0]
        after[filled - 1] = n
        before[np.concatenate(([0], filled[:-1]))] = n
        positions: dict[int, list[np.ndarray]] = defaultdict(list)
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            starts = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))).tolist()
            for s, e in zip(starts, [*starts[1:], len(rank)]):
                r = int(rank[s])
                if r not in positions:
                    heapq.heappush(active, r)
                positions[r].append(at[s:e])

        enter(np.arange(n))
        while active:
            r = heapq.heappop(active)
            lists = positions.pop(r)
            left, right = self.left[r], self.right[r]
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            # A position may have been merged since it was entered, or entered twice.
            at = np.sort(at[(symbol[at] == left) & (symbol[after[at]] == right)])
            if not len(at):
                continue
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            if left == right:
                first = np.concatenate(([True], after[at[:-1]] != at[1:]))
                nth = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
                at = at[nth % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            symbol[at], symbol[gone] = self.made[r], -1
            after[at] = beyond
            before[beyond] = at
            before[n] = n
            previous = before[at]
            enter(np.concatenate((previous[previous < n], at[beyond < n])))
        alive = symbol[:n] >= 0
        counts = np.concatenate(([0], np.cumsum(alive)))
        return symbol[:n][alive], counts[np.concatenate(([0], ends))]


@lru_cache(maxsize=1)
def _index(path: str) -> PairIndex:
    return PairIndex(byte_vocabulary(path))


class Encoded(NamedTuple):
    numbered: list[list[int]]  # each text as numbers of units; those below zero count from the end
    units: list[list[int]]  # each unit as numbers of words
    ids: np.ndarray  # all words' ids
    ends: np.ndarray  # where each word's begin, and the end of the last


def encode_texts(texts: list[str], path: str) -> Encoded:
    """The texts' units and the ids of their distinct words; an added token is a unit and a word of its own."""
    added = byte_vocabulary(path).added
    special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
    units, firsts, numbered = numbering(), numbering(), []
    number = units.__getitem__
    for text in texts:
        numbers: list[int] = []
        for i, span in enumerate(special.split(text) if any(a in text for a in added) else [text]):
            if i % 2:
                numbers.append(-1 - firsts[(span, True)])
            elif span:
                # A span's first unit has no blank before it.
                found = parts(span)
                first = -1 - firsts[(found[0], False)]
                found[0] = found[-1]
                found = list(map(number, found))
                found[0] = first
                numbers += found
        numbered.append(numbers)
    words, find = numbering(), _WORDS.findall
    number = words.__getitem__
    of_unit = [list(map(number, find(" " + u))) for u in units]
    specials = list(added)
    heads = [[-1 - specials.index(text)] if whole else list(map(number, find(text))) for text, whole in firsts]
    ids, ends = _index(path).encode([w.encode("utf-8") for w in words])
    # The added tokens are the last words, the first units the last units.
    ids, ends = np.append(ids, [added[a] for a in specials]), np.append(ends, ends[-1] + 1 + np.arange(len(specials)))
    of_unit += [[len(words) - 1 - w if w < 0 else w for w in x] for x in reversed(heads)]
    return Encoded(numbered, of_unit, ids.astype(np.int64), ends)


def _slices(texts: list, ends: np.ndarray, by):
    """The texts of each span of places, joined by ``by``."""
    places = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + len(by))))[ends]
    whole = by.join(texts)
    return [whole[a:b] for a, b in zip(places[:-1].tolist(), (places[1:] - len(by)).tolist())]


def _digests(texts: list[str], path: str) -> Iterator[tuple[int, str, str]]:
    made = encode_texts(texts, path)
    ids = made.ids.tolist()
    word = _slices(list(map(_decimals(path).__getitem__, ids)), made.ends, ",").__getitem__
    written = [word(x[0]) if len(x) == 1 else ",".join(map(word, x)) for x in made.units].__getitem__
    word = _slices(list(map(byte_vocabulary(path).tokens.__getitem__, ids)), made.ends, b"").__getitem__
    read = [word(x[0]) if len(x) == 1 else b"".join(map(word, x)) for x in made.units].__getitem__
    for numbers in made.numbered:
        joined = ",".join(map(written, numbers))
        decoded = b"".join(map(read, numbers)).decode("utf-8", "replace")
        yield joined.count(",") + bool(joined), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()


@lru_cache(maxsize=1)
def _decimals(path: str) -> list[str]:
    return list(map(str, range(len(byte_vocabulary(path).tokens))))


def blocks(batches: Iterator[pa.RecordBatch], column: int, block: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches, joined or cut to about ``block`` bytes of text; a longer text is a block of its own."""
    held, size = [], 0
    for b in batches:
        lengths = np.diff(np.frombuffer(b.column(column).buffers()[1], np.int32)[b.column(column).offset :][: len(b) + 1]) if len(b) else np.zeros(0)
        start = 0
        while start < len(b):
            room = np.searchsorted(np.cumsum(lengths[start:]), block - size, side="right")
            end = min(len(b), start + max(int(room), 0 if held else 1))
            if end > start:
                held.append(b.slice(start, end - start))
                size += int(lengths[start:end].sum())
            if end < len(b):
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
            start = end
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def round_trip(documents: DataFrame, tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by commas), decoded_sha256 (of the text that the ids give again)."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1, block):
            n, ids, decoded = zip(*_digests(b.column(1).to_pylist(), path))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(documents: DataFrame, tokenizer: str | None = None, block: int = BLOCK, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ids, array<int>."""
    path = tokenizer or default_tokenizer()
    kept = documents.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, len(keep), block):
            made = encode_texts(b.column(len(keep)).to_pylist(), path)
            words = np.split(made.ids.astype(np.int32), made.ends[1:-1])
            rows = [np.concatenate([words[w] for u in n for w in made.units[u]]) if len(n) else np.zeros(0, np.int32) for n in made.numbered]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, pa.list_(pa.int32()))], names=[*keep, "ids"])

    out = StructType([*kept.schema, StructField("ids", ArrayType(IntegerType()))])
    return documents.select(*keep, text_of().alias("__text")).mapInArrow(run, out)


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The table with its ids replaced by text; bytes that are no UTF-8 become U+FFFD."""
    path = tokenizer or default_tokenizer()
    names = [c for c in encoded.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_vocabulary(path).tokens
        for b in batches:
            texts = [b"".join(map(tokens.__getitem__, x or ())).decode("utf-8", "replace") for x in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*names, "text"])

    return encoded.select(*names, "ids").mapInArrow(run, StructType([*encoded.select(*names).schema, StructField("text", StringType())]))
