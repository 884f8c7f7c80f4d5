"""Table functions for SQL: chunks and sentences of a table of texts.

``register(spark)`` makes ``SELECT * FROM chunks(TABLE(SELECT doc_id AS key, text FROM documents) PARTITION BY key)`` and ``sentences`` of the same
arguments.  They take a batch of rows at a time as Arrow data, and give what ``operators.chunking.chunk`` and ``functions.text.sentences`` give.  The
columns ``key`` (any value, given back as text) and ``text`` are found by their names; others are ignored.  PARTITION BY says how rows are dealt
to tasks; it does not change the result, as every row is a text of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from lexweave.operators.chunking import MAX_CHARS, OVERLAP_SENTENCES

_HEADING = re.compile(r"#{1,6}\s+\S")
_BREAK_BEFORE = re.compile(r"^(?=#{1,6}[^\S\n]+\S)", re.M)
_BLANK_LINES = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_BOUNDARY = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+")
# The characters that Unicode calls white space, as ``functions.text.stripped`` takes them.
_WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def chunk_rows(text: str | None, most: int = MAX_CHARS, overlap: int = OVERLAP_SENTENCES) -> list[tuple[str, str]]:
    """(text, heading) of each chunk, in order."""
    whole = re.sub("\r\n?", "\n", text or "").strip(_WHITE) + "\n"
    done, open_, size, heading = [], [], 0, ""
    for block in _BLANK_LINES.split(_BREAK_BEFORE.sub("\n\n", whole)):
        block = block.strip(_WHITE)
        if not block:
            continue
        titled = bool(_HEADING.match(block))
        own = len(block) + (2 if open_ else 0)
        full = bool(open_) and size + own > most
        if open_ and (titled or full):
            done.append(("\n\n".join(open_).strip(_WHITE), heading))
        if titled:
            open_, size, heading = [block], len(block), block
        elif full:
            parts = _BOUNDARY.split(open_[-1])
            tail = [] if not overlap else [open_[-1] if len(parts) <= overlap else " ".join(parts[-overlap:])]
            open_, size = [*tail, block], sum(map(len, tail)) + own
        else:
            open_, size = [*open_, block], size + own
    if open_:
        done.append(("\n\n".join(open_).strip(_WHITE), heading))
    return done


def sentence_rows(text: str | None) -> list[str]:
    return [s for s in (p.strip(_WHITE) for p in _BOUNDARY.split((text or "").strip(_WHITE))) if s]


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _keys(batch: pa.RecordBatch) -> list[str | None]:
    return [None if k is None else str(k) for k in _column(batch, "key")]


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


_CHUNKS = pa.schema([("key", pa.string()), ("chunk_index", pa.int32()), ("text", pa.string()), ("heading_context", pa.string())])
_SENTENCES = pa.schema([("key", pa.string()), ("sentence_index", pa.int32()), ("sentence", pa.string())])


@arrow_udtf(returnType="key string, chunk_index int, text string, heading_context string")
class Chunks:
    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        yield _table(_CHUNKS, [(k, i, t, h) for k, text in zip(_keys(batch), _column(batch, "text")) for i, (t, h) in enumerate(chunk_rows(text))])


@arrow_udtf(returnType="key string, sentence_index int, sentence string")
class Sentences:
    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        yield _table(_SENTENCES, [(k, i, s) for k, text in zip(_keys(batch), _column(batch, "text")) for i, s in enumerate(sentence_rows(text))])


def register(spark: SparkSession) -> None:
    """The functions' names for this session's SQL."""
    spark.udtf.register("chunks", Chunks)
    spark.udtf.register("sentences", Sentences)
