"""Paragraphs and heading-aware overlapping chunks, as array expressions over one row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import SENTENCE_BOUNDARY, let, normalize, stripped

# Default sizes.
MAX_CHARS = 2500
OVERLAP_SENTENCES = 2
SAMPLE_CHUNK = 2000
SAMPLE_CHARS = 8000
SUMMARY_CHARS = 500
SUMMARY_PART = 250


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines; a heading line starts a block too."""
    broken = let(text, lambda t: F.when(F.contains(t, F.lit("#")), F.regexp_replace(t, r"(?m)^(?=#{1,6}[^\S\n]+\S)", "\n\n")).otherwise(t))
    return F.filter(F.transform(F.split(broken, r"\n[^\S\n]*(?:\n[^\S\n]*)+"), stripped), lambda p: p != "")


def _tail(paragraph: Column, overlap: int) -> Column:
    s = F.split(paragraph, SENTENCE_BOUNDARY)
    return F.when(F.size(s) <= overlap, paragraph).otherwise(F.array_join(F.slice(s, -overlap, overlap), " "))


def chunk_array(text: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_SENTENCES) -> Column:
    """An array of (text, heading): an ordered fold over the paragraphs.

    A heading closes the open chunk and begins one without overlap; a paragraph that would exceed max_chars closes the
    open chunk and begins one with the last sentences of the paragraph before it.  One over max_chars stays whole.
    """
    state = "struct<done:array<struct<text:string,heading:string>>,open:array<string>,size:int,heading:string>"
    empty = F.from_json(F.lit('{"done":[],"open":[],"size":0,"heading":""}'), state)
    closed = lambda s: F.concat(s["done"], F.array(F.struct(stripped(F.array_join(s["open"], "\n\n")).alias("text"), s["heading"].alias("heading"))))

    def step(s: Column, p: Column) -> Column:
        heading, some = p.rlike(r"^#{1,6}\s+\S"), F.size(s["open"]) > 0
        own = F.length(p) + F.when(some, 2).otherwise(0)
        full = some & (s["size"] + own > max_chars)
        done = F.when(some & (heading | full), closed(s)).otherwise(s["done"])
        if overlap:
            tail = _tail(F.element_at(s["open"], -1), overlap)
            began, began_size = F.array(tail, p), F.length(tail) + own
        else:
            began, began_size = F.array(p), own
        opened = F.when(heading, F.array(p)).when(full, began).otherwise(F.concat(s["open"], F.array(p)))
        size = F.when(heading, F.length(p)).when(full, began_size).otherwise(s["size"] + own)
        return F.struct(done.alias("done"), opened.alias("open"), size.cast("int").alias("size"), F.when(heading, p).otherwise(s["heading"]).alias("heading")).cast(state)

    return F.aggregate(paragraphs(normalize(F.coalesce(text, F.lit("")))), empty, step, lambda s: F.when(F.size(s["open"]) > 0, closed(s)).otherwise(s["done"]))


def chunk(documents: DataFrame, key: str, text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_SENTENCES) -> DataFrame:
    """key, chunk_index, text, heading_context."""
    chunks = chunk_array(F.col(text), max_chars, overlap)
    return documents.select(key, F.posexplode(chunks).alias("chunk_index", "c")).select(key, "chunk_index", F.col("c.text").alias("text"), F.col("c.heading").alias("heading_context"))


def reassemble(chunks: DataFrame, key: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: stripped(c["text"]))
    return chunks.groupBy(key).agg(F.concat(stripped(F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")), F.lit("\n")).alias("text"))


def document_summary(text: Column) -> Column:
    """The beginnings of the first and last chunk."""

    def made(c: Column) -> Column:
        head = lambda i: F.left(F.element_at(c, i)["text"], F.lit(SUMMARY_PART))
        return F.when(F.size(c) == 0, text).when(F.size(c) == 1, head(1)).otherwise(F.concat(head(1), F.lit("\n...\n"), head(-1)))

    return F.left(let(chunk_array(text, SAMPLE_CHUNK, 0), made), F.lit(SUMMARY_CHARS))


def language_sample(text: Column) -> Column:
    """The first, middle and last chunk."""

    def made(c: Column) -> Column:
        n = F.size(c)
        middle = F.when(n > 2, F.slice(c, F.floor(n / 2).cast("int") + 1, 1)).otherwise(F.slice(c, 1, 0))
        last = F.when(n > 1, F.slice(c, -1, 1)).otherwise(F.slice(c, 1, 0))
        return F.array_join(F.transform(F.concat(F.slice(c, 1, 1), middle, last), lambda x: x["text"]), "\n\n")

    return F.left(let(chunk_array(text, SAMPLE_CHUNK, 0), made), F.lit(SAMPLE_CHARS))
