"""Jobs over documents as tables: resume, alerts, issues, status and cost rollups, summaries and quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.formats import cost, language_name
from lexweave.functions.text import stripped

# Caps and thresholds, statuses with their ranks and exit codes, headlines.
MOST_WARNINGS = 3
MOST_REVIEW_ITEMS = 4
CHARS_PER_PAGE = 50
OCR_BELOW = 25
MAX_BYTES = 20_000_000
STATUSES = ["completed", "completed_with_warnings", "failed"]
HEADLINES = {
    "failed": "Translation did not complete successfully.",
    "no_translate": "Translation was skipped; original text was exported without translation.",
    "warnings": "Translation completed with warnings.",
    "completed": "Translation completed successfully.",
}
REVIEW_DEFAULT = "A significant translation difference may need your review."


def completed_prefix(chunks: DataFrame, memo: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks (keys, chunk_index, source_hash, llm, pass_num) before the first that the memo lacks for the same text, model and pass, with its text."""
    on = [*keys, "chunk_index", "source_hash", "llm", "pass_num"]
    joined = chunks.join(memo.select(*on, F.col("text").alias("memo_text")), on, "left")
    run = [*keys, "llm", "pass_num"]
    gaps = joined.where("memo_text is null").groupBy(*run).agg(F.min("chunk_index").alias("gap"))
    out = joined.join(gaps, run, "left").where("gap is null or chunk_index < gap")
    return out.drop("gap")


def alerts(text: Column, pages: Column, size: Column, encoding_loss: Column) -> Column:
    """An array of the codes of a text's extraction alerts."""
    n = F.coalesce(F.length(text), F.lit(0))
    sparse = F.when(F.coalesce(pages, F.lit(0)) > 0, n / pages < CHARS_PER_PAGE).otherwise(False)
    all_of = [(encoding_loss, "ENCODING_LOSS"), (n == 0, "EMPTY_EXTRACTION"), (sparse, "LOW_TEXT_DENSITY"), (size > MAX_BYTES, "LARGE_INPUT_FILE")]
    return F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in all_of]), lambda x: x.isNotNull())


def page_text(native: Column, ocr: Column) -> Column:
    """Recognised text in place of a sparse page's own, if it is longer."""
    length = lambda c: F.length(stripped(F.coalesce(c, F.lit(""))))
    return F.when((length(native) < OCR_BELOW) & (length(ocr) > length(native)), ocr).otherwise(native)


def job_status(issues: DataFrame, failed: Column) -> DataFrame:
    """job_id, n_issues, n_warnings, status of issues (job_id, severity)."""
    bad = F.col("severity").isin("warn", "error")
    status = F.when(F.max(failed.cast("int")) == 1, STATUSES[2]).when(F.max(bad.cast("int")) == 1, STATUSES[1]).otherwise(STATUSES[0])
    return issues.groupBy("job_id").agg(F.count("severity").alias("n_issues"), F.sum(F.when(bad, 1).otherwise(0)).alias("n_warnings"), status.alias("status"))


def batch_status(jobs: DataFrame) -> DataFrame:
    """One row: jobs by status, the worst status and its exit code (0, 3 for warnings, 2 for failures)."""
    count = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0))
    rows = jobs.agg(count(STATUSES[0]).alias("completed"), count(STATUSES[1]).alias("with_warnings"), count(STATUSES[2]).alias("failed"))
    status = F.when(F.col("failed") > 0, STATUSES[2]).when(F.col("with_warnings") > 0, STATUSES[1]).otherwise(STATUSES[0])
    code = F.when(F.col("failed") > 0, 2).when(F.col("with_warnings") > 0, 3).otherwise(0)
    return rows.withColumns({"status": status, "exit_code": code})


def latest_status(events: DataFrame) -> DataFrame:
    """Of job events, each job's last; ties of time go to the later stage by progress."""
    rest = [c for c in events.columns if c != "job_id"]
    last = F.max_by(F.struct(*rest), F.struct("updated_at", "progress")).alias("last")
    return events.groupBy("job_id").agg(last).select("job_id", "last.*")


def usage_cost(calls: DataFrame) -> DataFrame:
    """job_id, selector, n_calls, tokens_in, tokens_out, cost of calls; negative counts are zero."""
    total = lambda c: F.sum(F.greatest(F.col(c), F.lit(0))).alias(c)
    out = calls.groupBy("job_id", "selector").agg(F.count("*").alias("n_calls"), total("tokens_in"), total("tokens_out"))
    return out.withColumn("cost", cost(F.col("selector"), F.col("tokens_in"), F.col("tokens_out")))


def headline(status: Column, no_translate: Column, skipped: Column, target: Column) -> Column:
    passed = F.concat(F.lit("Document was already in "), language_name(target), F.lit("; text was passed through without translation."))
    out = F.when(status == STATUSES[2], HEADLINES["failed"]).when(no_translate, HEADLINES["no_translate"]).when(skipped, passed)
    return out.when(status == STATUSES[1], HEADLINES["warnings"]).otherwise(HEADLINES["completed"])


def top_warnings(issues: DataFrame) -> DataFrame:
    """job_id, warnings: the first messages of warnings and errors by pos; a ranked window, so a job's issues are never gathered."""
    w = Window.partitionBy("job_id").orderBy("pos")
    rows = issues.where(F.col("severity").isin("warn", "error")).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= MOST_WARNINGS)
    ordered = F.array_sort(F.collect_list(F.struct("nth", "message")))
    return rows.groupBy("job_id").agg(F.transform(ordered, lambda x: x["message"]).alias("warnings"))


def review_items(found: DataFrame, key: str) -> DataFrame:
    """key, items: explanations of the first unresolved breaking discrepancies by pos, and how many more there are."""
    found = found.where("severity = 'breaking' and not resolved")
    total = found.groupBy(key).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("pos")
    rows = found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= MOST_REVIEW_ITEMS).join(total, key)
    text = F.coalesce(F.nullif(F.col("explanation"), F.lit("")), F.lit(REVIEW_DEFAULT))
    items = F.transform(F.array_sort(F.collect_list(F.struct("nth", text.alias("t")))), lambda x: x["t"])
    more = F.max("n") - MOST_REVIEW_ITEMS
    rest = F.array(F.concat(F.lit("+ "), more.cast("string"), F.lit(" more item(s) listed in the job metadata.")))
    return rows.groupBy(key).agg(F.when(more > 0, F.concat(items, rest)).otherwise(items).alias("items"))


def cover(m: dict[str, Column]) -> Column:
    """The cover page's Markdown of columns source_file, date, job_id, status, no_translate, skipped, source_lang, target_lang, model, legal, quick, warnings, items."""
    line = lambda label, value: F.concat(F.lit(f"**{label}:** "), value)
    named = F.concat(m["source_lang"], F.lit(" → "), language_name(m["target_lang"]), F.lit(" ("), m["target_lang"], F.lit(") (model: "), m["model"], F.lit(")"))
    known = m["source_lang"].isNotNull() & (m["source_lang"] != "")
    language = F.when(m["no_translate"], F.when(known, line("Language", F.concat(m["source_lang"], F.lit(" (detected; not translated)")))))
    language = language.when(m["skipped"], F.lit(None)).when(known, line("Language", named)).otherwise(line("Model", m["model"]))
    section = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n## {title}\n\n- "), F.array_join(items, "\n- ")))
    subject = F.when(m["no_translate"], "original").otherwise("translated")
    parts = [
        F.lit("# Translation Summary\n"),
        line("Document", m["source_file"]),
        line("Date", m["date"]),
        line("Job reference", F.concat(F.lit("`"), m["job_id"], F.lit("`\n"))),
        line("Outcome", headline(m["status"], m["no_translate"], m["skipped"], m["target_lang"])),
        language,
        F.when(m["legal"], "**Document type:** Legal document"),
        F.when(m["quick"] & ~m["skipped"] & ~m["no_translate"], "**Mode:** Quick (single-pass; no dual-pass verification)"),
        section("Warnings", m["warnings"]),
        section("Items requiring your attention", m["items"]),
        F.concat(F.lit("\n*The "), subject, F.lit(" document begins on the next page.*\n")),
    ]
    return F.concat_ws("\n", *parts)


def qa_rows(rows: DataFrame, golden: DataFrame) -> DataFrame:
    """Rows (file, backend, chars, pages, error, hash) with their checks against golden (file, backend, min_chars, golden_hash)."""
    out = rows.join(golden, ["file", "backend"], "left")
    checks = {
        "extract_ok": F.col("error").isNull(),
        "min_chars_ok": F.coalesce(F.coalesce("chars", F.lit(0)) >= F.coalesce("min_chars", F.lit(1)), F.lit(False)),
        "pages_ok": (F.coalesce("pages", F.lit(1)) > 0) if "pages" in rows.columns else F.lit(True),
        "hash_ok": F.col("golden_hash").isNull() | F.coalesce(F.col("hash") == F.col("golden_hash"), F.lit(False)),
    }
    out = out.withColumns(checks)
    return out.withColumn("passed", F.col("extract_ok") & F.col("min_chars_ok") & F.col("pages_ok") & F.col("hash_ok"))


def qa_summary(rows: DataFrame) -> DataFrame:
    """total, passed, failed, pass_rate (one digit; 100 where there are no rows)."""
    out = rows.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("passed").cast("long")), F.lit(0)).alias("passed"))
    rate = F.when(F.col("total") == 0, 100.0).otherwise(F.round(100.0 * F.col("passed") / F.greatest("total", F.lit(1)), 1))
    return out.select("total", "passed", (F.col("total") - F.col("passed")).alias("failed"), rate.alias("pass_rate"))


def issues_of_alerts(rows: DataFrame) -> DataFrame:
    """Issues (job_id, code, severity, message, stage, pos) of rows (job_id, alerts, an array of codes)."""
    code = F.col("code")
    severity = F.when(code == "EMPTY_EXTRACTION", "error").when(code == "LARGE_INPUT_FILE", "info").otherwise("warn")
    out = rows.select("job_id", F.posexplode("alerts").alias("pos", "code"))
    return out.select("job_id", "code", severity.alias("severity"), F.concat(F.lit("Extraction: "), F.lower(F.replace(code, F.lit("_"), F.lit(" ")))).alias("message"), F.lit("extracting").alias("stage"), F.col("pos").cast("long").alias("pos"))


def job_summary(jobs: DataFrame, issues: DataFrame, found: DataFrame) -> DataFrame:
    """job_id, headline, warnings, items of jobs (job_id, status, no_translate, skipped, target_lang), their issues and discrepancies."""
    head = headline(F.col("status"), F.col("no_translate"), F.col("skipped"), F.col("target_lang"))
    none = F.array().cast("array<string>")
    out = jobs.join(top_warnings(issues), "job_id", "left").join(review_items(found, "job_id"), "job_id", "left")
    return out.select("job_id", head.alias("headline"), F.coalesce("warnings", none).alias("warnings"), F.coalesce("items", none).alias("items"))


def _yes(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "yes").otherwise("no")


def _table(heads: list[str], cells: list[Column], rows: Column) -> Column:
    """A Markdown table of an array of structs, or null where it is empty; a bar within a cell becomes a slash."""
    line = lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(c(x).cast("string"), F.lit("")), F.lit("|"), F.lit("/")) for c in cells]), F.lit(" |"))
    head = "| " + " | ".join(heads) + " |\n|" + "|".join("-" * (len(h) + 2) for h in heads) + "|\n"
    return F.when(F.size(rows) > 0, F.concat(F.lit(head), F.array_join(F.transform(rows, line), "\n")))


def results_report(jobs: DataFrame, issues: DataFrame, found: DataFrame | None = None, artifacts: Column | None = None) -> DataFrame:
    """job_id, markdown: outcome, language, classification, alerts, issues by pos, artifacts, discrepancies, what needs review, time.

    ``jobs`` has job_id, status, no_translate, skipped, source_lang, target_lang and may have source_file, model, confidence, used_ai,
    is_legal, legal_used_ai, method, pages, chunks, calls, format, exported, alerts (codes), stage, error and seconds; what it lacks is n/a.
    ``found`` has job_id, chunk_index, sentence_index, severity, resolved, explanation.  A job's report is one text, so its rows are one cell.
    """
    none = F.lit("_(none)_")
    own = lambda name, kind="string": F.col(name).cast(kind) if name in jobs.columns else F.lit(None).cast(kind)
    or_none = lambda c: F.coalesce(c, F.lit("n/a"))
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    lists = issues.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("pos", "code", "severity", "stage", "message"))).alias("own_issues"))
    out = jobs.join(lists, "job_id", "left")
    if found is not None:
        one = F.struct("chunk_index", "sentence_index", "severity", "resolved", "explanation")
        out = out.join(found.groupBy("job_id").agg(F.array_sort(F.collect_list(one)).alias("own_found")), "job_id", "left")
    differences = F.col("own_found") if found is not None else F.lit(None).cast("array<struct<chunk_index:int,sentence_index:int,severity:string,resolved:boolean,explanation:string>>")
    get = lambda name: lambda x: x[name]
    target, source = F.col("target_lang"), F.coalesce("source_lang", F.lit("unknown"))
    name = language_name(target)
    summary = F.when(F.col("status") == STATUSES[2], "The translation did not complete.").when(F.col("no_translate"), "No translation was asked for; the text is exported as it is.")
    summary = summary.when(F.col("skipped"), F.concat(F.lit("The document is in "), name, F.lit(" already; the text is exported as it is.")))
    summary = summary.otherwise(F.concat(F.lit("Translated from **"), source, F.lit("** to "), name, F.lit(" ("), code(target), F.lit(") by "), code(or_none(own("model"))), F.lit(".")))
    item = lambda label, c: F.concat(F.lit(f"- {label}: "), c)
    failure = F.when(own("error").isNotNull(), F.concat(F.lit("\n\n## Failure\n\n"), F.coalesce(F.concat(F.lit("Stage "), code(own("stage")), F.lit(": ")), F.lit("")), own("error"))).otherwise("")
    alerts = F.array_join(F.transform(F.col("alerts"), lambda a: F.concat(F.lit("- **"), a, F.lit("**"))), "\n") if "alerts" in jobs.columns else F.lit("")
    files = F.lit(None).cast("string") if artifacts is None else F.array_join(F.transform(F.array_sort(F.map_entries(artifacts)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), _yes(e["value"]))), "\n")
    open_ones = F.filter(differences, lambda x: (x["severity"] == "breaking") & ~x["resolved"])
    review = F.array_join(F.transform(open_ones, lambda x: F.concat(F.lit("- **Breaking** (chunk "), x["chunk_index"].cast("string"), F.lit(", sentence "), x["sentence_index"].cast("string"), F.lit("): "), F.coalesce(x["explanation"], F.lit("")))), "\n")
    sections = {
        "Summary": summary,
        "Language": F.concat_ws("\n", item("Detected", code(source)), item("Target", F.concat(code(target), F.lit(" ("), name, F.lit(")"))), item("Confidence", or_none(own("confidence"))), item("Asked the model", _yes(own("used_ai", "boolean")))),
        "Document": F.concat_ws("\n", item("Legal", _yes(own("is_legal", "boolean"))), item("Asked the model whether legal", _yes(own("legal_used_ai", "boolean"))), item("Method", or_none(own("method"))), item("Pages", or_none(own("pages"))), item("Chunks", or_none(own("chunks"))), item("Calls", or_none(own("calls"))), item("Format", or_none(own("format"))), item("Exported", _yes(own("exported", "boolean")))),
        "Extraction alerts": F.coalesce(F.nullif(alerts, F.lit("")), none),
        "Issues": F.coalesce(_table(["Code", "Severity", "Stage", "Message"], [get(n) for n in ("code", "severity", "stage", "message")], F.col("own_issues")), none),
        "Artifacts": F.coalesce(F.nullif(files, F.lit("")), none),
        "Discrepancies": F.coalesce(_table(["Chunk", "Sentence", "Severity", "Resolved", "Explanation"], [get("chunk_index"), get("sentence_index"), get("severity"), lambda x: _yes(x["resolved"]), get("explanation")], differences), F.lit("The passes do not differ.")),
        "For review": F.coalesce(F.nullif(review, F.lit("")), none),
    }
    head = F.concat(F.lit("# Results\n\n**Outcome:** "), headline(F.col("status"), F.col("no_translate"), F.col("skipped"), target), F.coalesce(F.concat(F.lit("\n\nSource file: "), code(own("source_file"))), F.lit("")), failure)
    body = F.concat(head, *[F.concat(F.lit(f"\n\n## {title}\n\n"), text) for title, text in sections.items()])
    time = F.coalesce(F.concat(F.lit("\n\n## Time\n\n- "), F.format_number(own("seconds", "double"), 1), F.lit(" s")), F.lit(""))
    return out.select("job_id", F.concat(body, time, F.lit("\n")).alias("markdown"))
