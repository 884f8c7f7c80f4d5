"""Translation jobs from documents to exported texts: the operators in order, as one plan over all documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import rules as U
from lexweave.functions.text import cover_and_body, normalize, stripped
from lexweave.operators import detect as D
from lexweave.operators import glossary as G
from lexweave.operators import jobs as J
from lexweave.operators import translate as TR
from lexweave.operators.chunking import reassemble
from lexweave.operators.completion import CALL, Asking, Completion, counted
from lexweave.operators.ngrams import Profile, detect
from lexweave.operators.reconcile import FACTS, discrepancies, misaligned, resolved_chunks


class Options(NamedTuple):
    target: str = "en"
    llm: str = "cursor:composer-2.5"
    thorough: bool = False
    no_translate: bool = False
    fail_on_empty: bool = True
    include_cover: bool = True
    format: str = "md"
    date: str = ""
    context: str = ""
    glossary: str | None = None  # JSON


class Results(NamedTuple):
    outputs: DataFrame  # doc_id, status, source_lang, is_legal, skipped, text, markdown
    issues: DataFrame  # job_id, code, severity, message, stage, pos
    discrepancies: DataFrame | None
    memo: DataFrame | None
    usage: DataFrame | None = None  # job_id, selector, n_calls, tokens_in, tokens_out, cost


def _size(documents: DataFrame) -> tuple[Column, Column]:
    """Pages and bytes of the documents' files, where their reader has said them; else no pages and the text's bytes."""
    own = lambda name, kind, rest: F.col(name).cast(kind) if name in documents.columns else rest
    return own("pages", "int", F.lit(None).cast("int")), own("bytes", "long", F.octet_length("text").cast("long"))


def prepared(documents: DataFrame, options: Options, asking: Asking | None = None, profile: Profile | None = None) -> DataFrame:
    """Documents (doc_id, text, and if they have them source_lang, an override, pages and bytes of the file) with what the stages before translation find.

    Only texts of which the rules are unsure are asked for; ``calls`` has what was.
    """
    given = F.col("source_lang") if "source_lang" in documents.columns else F.lit(None).cast("string")
    body = F.coalesce(normalize(F.col("text")), F.lit(""))
    pages, size = _size(documents)
    rows = documents.select("doc_id", body.alias("text"), given.alias("override"), F.contains(F.coalesce("text", F.lit("")), F.lit("�")).alias("loss"), pages.alias("pages"), size.alias("bytes"))
    known = None
    if profile is not None:
        rows, known = detect(rows.withColumn("own_text", F.col("text")), "text", profile).withColumnsRenamed({"own_text": "text", "found": "known"}), F.col("known")
    calls = F.array().cast(f"array<{CALL}>")
    if asking is not None:
        rows = rows.withColumns({"call_1": asking.call(*D.language_prompt(F.col("text"), known=known)), "call_2": asking.call(*D.legal_prompt(F.col("text")))})
        calls = F.filter(F.array("call_1", "call_2"), lambda c: c["attempts"].isNotNull())
    answer = lambda n: None if asking is None else lambda system, user: F.col(f"call_{n}.answer")
    rows = rows.withColumns({"found": D.language(F.col("text"), answer(1), known=known), "law": D.legal(F.col("text"), answer(2)), "empty": stripped(F.col("text")) == ""})
    alerts = J.alerts(stripped(F.col("text")), F.col("pages"), F.col("bytes"), F.col("loss"))
    source = F.coalesce("override", "found.lang")
    skipped = U.skip_translation(F.lit(options.no_translate), source, F.lit(options.target))
    return rows.select(
        "doc_id", "text", "override", "found", "empty", source.alias("source_lang"), F.lit(options.target).alias("target_lang"), F.col("law.is_legal").alias("is_legal"),
        F.col("law.parse_failed").alias("unparsed"), alerts.alias("alerts"), skipped.alias("skipped"), (F.col("empty") & F.lit(options.fail_on_empty)).alias("failed"), F.lit(options.context).alias("context"), calls.alias("calls"),
    )


def issues_of(rows: DataFrame) -> DataFrame:
    """All issues of prepared documents; the job's id is the document's."""
    job = F.col("doc_id").cast("string").alias("job_id")
    found = J.issues_of_alerts(rows.select(job, "alerts"))
    note = lambda where, code, message, pos: rows.where(where).select(job, F.lit(code).alias("code"), F.lit("warn").alias("severity"), message.alias("message"), F.lit("detecting").alias("stage"), F.lit(pos).cast("long").alias("pos"))
    differs = F.concat(F.lit("The given source language "), "override", F.lit(" differs from the detected "), "found.lang")
    found = found.unionByName(note(D.source_mismatch(F.col("override"), F.col("found.lang")), "SOURCE_LANG_MISMATCH", differs, 100))
    low = F.col("override").isNull() & F.col("found.used_ai")
    found = found.unionByName(note(low, "LANGUAGE_LOW_CONFIDENCE", F.concat(F.lit("The language was asked for: "), F.col("found.lang")), 101))
    return found.unionByName(note(F.col("unparsed"), "LLM_RESPONSE_PARSE_FAILED", F.lit("The legal confirmation was no JSON object"), 102))


def _exported(rows: DataFrame, options: Options, warnings: Column, items: Column) -> Column:
    model = F.lit(options.llm)
    page = J.cover({
        "source_file": F.col("doc_id").cast("string"), "date": F.lit(options.date), "job_id": F.col("doc_id").cast("string"), "status": F.col("status"),
        "no_translate": F.lit(options.no_translate), "skipped": F.col("skipped") & F.lit(not options.no_translate), "source_lang": F.col("source_lang"), "target_lang": F.col("target_lang"),
        "model": model, "legal": F.col("is_legal"), "quick": F.lit(not options.thorough), "warnings": warnings, "items": items,
    })
    cover = page if options.include_cover else F.lit(None).cast("string")
    return cover_and_body(cover, F.col("text"), F.lit(options.format))


def _issue(rows: DataFrame, code: str, severity: str, message: Column, stage: str, pos: int) -> DataFrame:
    job = F.col("doc_id").cast("string").alias("job_id")
    return rows.select(job, F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), F.lit(stage).alias("stage"), F.lit(pos).cast("long").alias("pos"))


def _made_calls(rows: DataFrame, selector: str) -> DataFrame:
    """job_id, selector, tokens_in, tokens_out of rows' answered calls."""
    made = rows.select(F.col("doc_id").cast("string").alias("job_id"), F.explode("calls").alias("c")).where("c.error IS NULL")
    return made.select("job_id", F.lit(selector).alias("selector"), "c.tokens_in", "c.tokens_out")


def run(documents: DataFrame, complete: Completion | Asking, options: Options = Options(), memo: DataFrame | None = None, save: Callable[[DataFrame, str], DataFrame] = lambda df, name: df.checkpoint(), profile: Profile | None = None) -> Results:
    """Jobs of all documents: quick (one pass) or thorough (two passes, reconciled).

    ``save`` writes an intermediate table and reads it again (by default a checkpoint), as completions are dear and a lost executor
    would ask them again.  ``memo`` has what earlier runs translated; the result's memo has all rows, to be kept for the next run.
    Documents that are already in the target language, or are not to be translated, pass through; empty ones fail.  With an Asking a
    failed call is its document's failure and no other's: the document has no text, an issue tells the chunk, what succeeded is in the memo.
    With a ``profile`` (ngrams.profile of labelled texts) languages are found by n-grams, else by word lists.
    """
    asking = complete if isinstance(complete, Asking) else counted(complete)
    rows = save(prepared(documents, options, asking, profile), "prepared")
    terms = None if options.glossary is None else G.parse(F.lit(options.glossary))
    todo = rows.where(~F.col("skipped") & ~F.col("failed"))
    known = TR.memo_of(documents.sparkSession, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}") if memo is None else memo
    calls, passes, kept, on = [_made_calls(rows, options.llm)], [], [], ["doc_id", "chunk_index"]
    extra = issues_of(rows)
    lost = todo.limit(0).select("doc_id")
    for number in (1, 2) if options.thorough else (1,):
        chunks = TR.document_chunks(todo, "doc_id", options.llm, number)
        made = save(TR.attempt_chunks(chunks, asking, known, ["doc_id"], terms), f"pass{number}")
        bad = save(TR.failures(made, ["doc_id"]), f"failed{number}")
        said = F.concat(F.lit("Translation failed for chunk "), F.col("first_failed").cast("string"), F.lit(": "), "error")
        extra = extra.unionByName(_issue(bad, "PIPELINE_FAILED", "error", said, "translating", 200 + number))
        lost = lost.unionByName(bad.select("doc_id"))
        todo = todo.join(bad, "doc_id", "left_anti")
        passes.append(made.join(bad, "doc_id", "left_anti"))
        kept.append(TR.memo_rows(made, ["doc_id"]))
        calls.append(TR.calls_of(made, F.col("doc_id").cast("string"), options.llm))
    found = None
    if options.thorough:
        source = TR.document_chunks(todo, "doc_id", options.llm)
        odd = save(misaligned(source, passes[0].join(todo.select("doc_id"), "doc_id", "left_semi"), passes[1]), "misaligned")
        text = F.concat_ws("", F.lit("Chunks of source and passes differ: "), F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n_source", "n_one", "n_two")]))
        extra = extra.unionByName(_issue(odd, "CHUNK_COUNT_MISMATCH", "error", text, "reconciling", 210))
        lost = lost.unionByName(odd.select("doc_id"))
        source = source.join(odd, "doc_id", "left_anti").select(*on, F.col("text").alias("source"), *FACTS)
        pairs = source.join(passes[0].select(*on, F.col("text").alias("t1")), on).join(passes[1].select(*on, F.col("text").alias("t2")), on)
        found = save(discrepancies(pairs, asking, options.target, glossary=None if terms is None else G.tokens(terms), terms=terms), "discrepancies")
        calls.append(_made_calls(found, options.llm))
        unread = found.select("doc_id", F.explode("unparsed").alias("what")).groupBy("doc_id", "what").agg(F.count("*").alias("n"))
        text = F.concat(F.lit("Answers that were no JSON object ("), "what", F.lit("): "), F.col("n").cast("string"))
        extra = extra.unionByName(_issue(unread, "LLM_RESPONSE_PARSE_FAILED", "warn", text, "reconciling", 211))
        translated = reassemble(resolved_chunks(pairs, found), "doc_id")
        found = found.drop("calls", "unparsed")
    else:
        translated = reassemble(passes[0], "doc_id")
    issues = save(extra, "issues")
    lost = save(lost.distinct().withColumn("lost", F.lit(True)), "lost")
    own = rows.withColumn("job_id", F.col("doc_id").cast("string")).join(lost, "doc_id", "left").withColumn("failed", F.col("failed") | F.coalesce("lost", F.lit(False)))
    flags = own.select("job_id", "failed").join(issues.select("job_id", "severity"), "job_id", "left")
    status = J.job_status(flags, F.col("failed"))
    passed = own.where("skipped OR failed").select("doc_id", F.when(F.col("lost").isNull(), F.col("text")).alias("out"))
    texts = passed.unionByName(translated.join(lost, "doc_id", "left_anti").select("doc_id", F.col("text").alias("out")))
    out = own.drop("text").join(texts, "doc_id").join(status.select("job_id", "status"), "job_id").join(J.top_warnings(issues), "job_id", "left").withColumnRenamed("out", "text")
    none = F.array().cast("array<string>")
    items = none
    if found is not None:
        review = found.select(F.col("doc_id").cast("string").alias("job_id"), (F.col("chunk_index") * 1_000_000 + F.col("sentence_index")).alias("pos"), "severity", "resolved", "explanation")
        out = out.join(J.review_items(review, "job_id"), "job_id", "left")
        items = F.coalesce("items", none)
    out = out.withColumn("markdown", F.when(F.col("text").isNotNull(), _exported(out, options, F.coalesce("warnings", none), items)))
    asked = reduce(DataFrame.unionByName, calls)
    usage = own.select("job_id").join(J.usage_cost(asked), "job_id", "left").select("job_id", F.coalesce("selector", F.lit(options.llm)).alias("selector"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_calls", "tokens_in", "tokens_out")], F.coalesce("cost", F.lit(0.0)).alias("cost"))
    return Results(out.select("doc_id", "status", "source_lang", "is_legal", "skipped", "text", "markdown"), issues, found, reduce(DataFrame.unionByName, kept), usage)


def resume(documents: DataFrame, memo: DataFrame, options: Options) -> DataFrame:
    """doc_id, done, chunks: how many of each document's chunks the memo already has for the same text, model and first pass."""
    rows = documents.select("doc_id", F.coalesce(normalize(F.col("text")), F.lit("")).alias("text"))
    rows = rows.withColumns({"source_lang": F.lit(""), "target_lang": F.lit(options.target), "is_legal": F.lit(False), "context": F.lit("")})
    chunks = TR.document_chunks(rows, "doc_id", options.llm)
    on = ["doc_id", "chunk_index", *TR.MEMO]
    have = memo.select(*on).distinct().withColumn("have", F.lit(1))
    return chunks.join(have, on, "left").groupBy("doc_id").agg(F.count("have").alias("done"), F.count("*").alias("chunks"))
