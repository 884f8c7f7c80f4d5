"""Translation of chunks with a memo: what the memo has is not asked again, the rest meets the completion once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.formats import language_name
from lexweave.functions.text import source_hash, stripped
from lexweave.operators import glossary as G
from lexweave.operators.chunking import chunk, document_summary, reassemble
from lexweave.operators.completion import Asking, Completion

LEGAL_NOTE = " This is a legal document: keep its obligations and defined terms exactly."
#: Columns that name a memo's row, beside a chunk's keys.
MEMO = ["pass_num", "llm", "source_hash"]


def system_prompt(target: Column, glossary: Column | None = None) -> Column:
    terms = F.lit("")
    if glossary is not None:
        some = (F.size(glossary["keep"]) > 0) | (F.size(glossary["preferred"]) > 0)
        terms = F.when(some, " Follow the glossary: leave terms that are to be kept as they are and use the given translations.").otherwise("")
    return F.concat(
        F.lit("You are a professional translator of documents. Translate the text faithfully into "), language_name(target), F.lit(" ("), target,
        F.lit("). Keep the Markdown structure: headings, lists, numbering and paragraphs. In legal text keep modal verbs, names of parties, dates and amounts exactly."),
        F.coalesce(terms, F.lit("")), F.lit(" Return only the translated Markdown."),
    )


def context_block(context: Column, glossary: Column | None, summary: Column, section: Column) -> Column:
    """The labelled parts that are not blank, and a blank line; empty if all are."""
    part = lambda label, c: F.when(stripped(c) != "", F.concat(F.lit(label), stripped(c)))
    terms = F.lit(None).cast("string") if glossary is None else F.nullif(G.prompt_block(glossary), F.lit(""))
    parts = F.array_compact(F.array(part("Translation context:\n", context), terms, part("Document summary:\n", summary), part("Section context: ", section)))
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "\n"), F.lit("\n\n"))).otherwise("")


def _head(source: Column, target: Column, is_legal: Column) -> Column:
    note = F.when(is_legal, LEGAL_NOTE).otherwise("")
    return F.concat(F.lit("Source language: "), source, F.lit(". Target language: "), language_name(target), F.lit(" ("), target, F.lit(")."), note, F.lit("\n"))


def user_prompt(index: Column, text: Column, source: Column, target: Column, is_legal: Column, context: Column) -> Column:
    return F.concat(_head(source, target, is_legal), context, F.lit("Chunk "), (index + 1).cast("string"), F.lit("\n\n"), text)


def third_pass_prompt(span: Column, source: Column, target: Column, is_legal: Column, context: Column) -> Column:
    return F.concat(_head(source, target, is_legal), context, F.lit("Translate this span:\n\n"), span)


def memo_of(spark, keys: str = "doc_id long") -> DataFrame:
    """An empty memo."""
    return spark.createDataFrame([], f"{keys}, chunk_index int, pass_num int, llm string, source_hash string, text string")


def pending(chunks: DataFrame, memo: DataFrame | None, keys: list[str]) -> DataFrame:
    """Chunks (keys, chunk_index, MEMO) that the memo lacks: another text, model or pass is another chunk."""
    return chunks if memo is None else chunks.join(memo, [*keys, "chunk_index", *MEMO], "left_anti")


def translate_chunks(chunks: DataFrame, complete: Completion, memo: DataFrame | None, keys: list[str], glossary: Column | None = None) -> DataFrame:
    """The memo's rows of all chunks: keys, chunk_index, MEMO, text.

    Chunks have keys, chunk_index, text, heading_context, MEMO, source_lang, target_lang, is_legal, summary and context.  The rows that are
    new come from pending(); append them to the memo as they are, a rerun finds them there.  Without a memo all are new, and chunks are made once.
    """
    wanted = [*keys, "chunk_index", *MEMO]
    context = context_block(F.col("context"), glossary, F.col("summary"), F.col("heading_context"))
    prompt = user_prompt(F.col("chunk_index"), F.col("text"), F.col("source_lang"), F.col("target_lang"), F.col("is_legal"), context)
    made = pending(chunks, memo, keys).withColumn("text", stripped(complete(system_prompt(F.col("target_lang"), glossary), prompt)))
    if memo is None:
        return made.select(*wanted, "text")
    # A memo may hold a row twice, as after a retried append.
    known = memo.groupBy(*wanted).agg(F.min("text").alias("text")).join(chunks.select(*wanted), wanted, "left_semi")
    return known.select(*wanted, "text").unionByName(made.select(*wanted, "text"))


def attempt_chunks(chunks: DataFrame, asking: Asking, memo: DataFrame, keys: list[str], glossary: Column | None = None) -> DataFrame:
    """All chunks as translate_chunks() takes them: keys, chunk_index, MEMO, text, error, tokens_in, tokens_out, known (from the memo).

    A chunk whose call failed has an error and no text; it concerns no other chunk.  memo_rows() of the result is the memo's.
    """
    wanted = [*keys, "chunk_index", *MEMO]
    context = context_block(F.col("context"), glossary, F.col("summary"), F.col("heading_context"))
    prompt = user_prompt(F.col("chunk_index"), F.col("text"), F.col("source_lang"), F.col("target_lang"), F.col("is_legal"), context)
    todo = pending(chunks, memo, keys)
    if asking.tasks:
        todo = todo.repartition(asking.tasks, *keys, "chunk_index")
    called = todo.select(*wanted, asking.call(system_prompt(F.col("target_lang"), glossary), prompt).alias("c"))
    made = called.select(*wanted, stripped(F.col("c.answer")).alias("text"), "c.error", "c.tokens_in", "c.tokens_out", F.lit(False).alias("known"))
    kept = memo.groupBy(*wanted).agg(F.min("text").alias("text")).join(chunks.select(*wanted), wanted, "left_semi")
    nothing = F.lit(0).cast("long")
    return kept.select(*wanted, "text", F.lit(None).cast("string").alias("error"), nothing.alias("tokens_in"), nothing.alias("tokens_out"), F.lit(True).alias("known")).unionByName(made)


def memo_rows(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Of attempt_chunks() the rows to keep: those that succeeded."""
    return attempts.where("error IS NULL").select(*keys, "chunk_index", *MEMO, "text")


def failures(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chunks, failed, first_failed (chunk_index), error of the documents with a failed chunk."""
    bad = F.col("error").isNotNull()
    first = F.min(F.when(bad, F.struct("chunk_index", "error"))).alias("first")
    out = attempts.groupBy(*keys).agg(F.count("*").alias("chunks"), F.count("error").alias("failed"), first).where("failed > 0")
    return out.select(*keys, "chunks", "failed", F.col("first.chunk_index").alias("first_failed"), F.col("first.error").alias("error"))


def document_results(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per document of attempt_chunks(), in one aggregation: status, chunks, failed, first_failed, error, text, n_calls, tokens_in, tokens_out.

    A document with a failed chunk has failed and has no text; its other chunks are in the memo all the same.
    """
    bad = F.col("error").isNotNull()
    asked = (~F.col("known")) & ~bad
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", F.coalesce("text", F.lit("")).alias("text")))), lambda c: stripped(c["text"]))
    text = F.concat(stripped(F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")), F.lit("\n"))
    first = F.min(F.when(bad, F.struct("chunk_index", "error")))
    out = attempts.groupBy(*keys).agg(
        F.count("*").alias("chunks"), F.count("error").alias("failed"), first.alias("first"), text.alias("text"),
        F.count(F.when(asked, 1)).alias("n_calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
    )
    whole = F.col("failed") == 0
    return out.select(*keys, F.when(whole, "completed").otherwise("failed").alias("status"), "chunks", "failed", F.col("first.chunk_index").alias("first_failed"), F.col("first.error").alias("error"), F.when(whole, F.col("text")).alias("text"), "n_calls", "tokens_in", "tokens_out")


def calls_of(attempts: DataFrame, job: Column, selector: str) -> DataFrame:
    """job_id, selector, tokens_in, tokens_out of every call that was made and answered."""
    return attempts.where("NOT known AND error IS NULL").select(job.alias("job_id"), F.lit(selector).alias("selector"), "tokens_in", "tokens_out")


def document_chunks(documents: DataFrame, key: str, llm: str, pass_num: int = 1, max_chars: int = 2500, overlap: int = 2) -> DataFrame:
    """Chunks of documents (key, text, source_lang, target_lang, is_legal, context) as translate_chunks() takes them.

    The shared columns stay on the rows that explode, so nothing is shuffled.
    """
    shared = documents.select(key, "text", "source_lang", "target_lang", "is_legal", F.coalesce("context", F.lit("")).alias("context"), document_summary(F.col("text")).alias("summary"), source_hash(F.col("text")).alias("source_hash"))
    rest = ["source_lang", "target_lang", "is_legal", "context", "summary", "source_hash"]
    rows = chunk(shared.withColumn("__key", F.struct(key, *rest)), "__key", "text", max_chars, overlap)
    return rows.select("__key.*", F.col("chunk_index").cast("int").alias("chunk_index"), "text", "heading_context", F.lit(pass_num).alias("pass_num"), F.lit(llm).alias("llm"))


def translate_documents(documents: DataFrame, complete: Completion, key: str, llm: str, glossary: Column | None = None, memo: DataFrame | None = None) -> DataFrame:
    """key, text: every document's translated chunks, joined again."""
    chunks = document_chunks(documents, key, llm)
    return reassemble(translate_chunks(chunks, complete, memo, [key], glossary), key)
