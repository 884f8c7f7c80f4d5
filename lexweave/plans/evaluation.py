"""Evaluation of text readers: files by backends, timed, scored against golden texts, as rows, lines or an HTML page."""

from __future__ import annotations

import hashlib
import html
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.formats import IMAGE_SUFFIXES, OFFICE_SUFFIXES, suffix
from lexweave.operators.jobs import qa_rows, qa_summary

#: From a file's bytes to its text, pages (None where there are none) and the way it was read.
Provider = Callable[[bytes], tuple[str, int | None, str]]

CASE = "file: string, backend: string, pdf_ocr: boolean, min_chars: int, normalized_text_sha256: string"
ROWS = "file string, backend string, chars long, pages int, elapsed_ms double, method string, hash string, error string"


def golden(spark: SparkSession, path: str) -> DataFrame:
    """file, backend, pdf_ocr, min_chars, golden_hash of a manifest file."""
    cases = spark.read.schema(f"cases array<struct<{CASE}>>").json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")
    return cases.select("file", "backend", F.coalesce("pdf_ocr", F.lit(False)).alias("pdf_ocr"), F.coalesce("min_chars", F.lit(1)).alias("min_chars"), F.col("normalized_text_sha256").alias("golden_hash"))


def write_golden(rows: DataFrame, path: str) -> None:
    """A manifest of golden() rows as one JSON text in a folder; a manifest is small, as people keep it."""
    case = F.struct("file", "backend", F.col("pdf_ocr"), F.col("min_chars"), F.col("golden_hash").alias("normalized_text_sha256"))
    rows.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.array_sort(F.collect_list(case)).alias("cases"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def golden_of(rows: DataFrame, min_chars: int = 1, pdf_ocr: bool = False) -> DataFrame:
    """Golden rows that take measured rows as they are; failed ones are left out."""
    return rows.where("error IS NULL").select("file", "backend", F.lit(pdf_ocr).alias("pdf_ocr"), F.lit(min_chars).alias("min_chars"), F.col("hash").alias("golden_hash"))


def _hash(text: str) -> str:
    return hashlib.sha256(text.replace("\r\n", "\n").replace("\r", "\n").strip().encode("utf-8", "replace")).hexdigest()


def measured(spark: SparkSession, path: str, backends: dict[str, Provider], unsupported: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each file with each backend; files are read once.

    ``unsupported`` lists suffixes by backend, whose files get an error row (by default those of offices and images for native).
    """
    without = {"native": [*OFFICE_SUFFIXES, *IMAGE_SUFFIXES]} if unsupported is None else unsupported

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, kind, content in zip(b["file"], b["suffix"], b["content"]):
                for backend, read in backends.items():
                    if kind in without.get(backend, ()):
                        out.append((name, backend, None, None, None, None, None, f"{backend} does not support .{kind} files"))
                        continue
                    start = time.perf_counter()
                    try:
                        text, pages, method = read(bytes(content))
                        took = round((time.perf_counter() - start) * 1000, 1)
                        out.append((name, backend, len(text), pages, took, method, _hash(text), None))
                    except Exception as e:  # noqa: BLE001  a reader's failure is its row
                        out.append((name, backend, None, None, round((time.perf_counter() - start) * 1000, 1), None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["file", "backend", "chars", "pages", "elapsed_ms", "method", "hash", "error"]).astype({"chars": "Int64", "pages": "Int32"})

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), suffix(F.col("path")).alias("suffix"), "content")
    return files.mapInPandas(rows, ROWS)


def scored(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Measured rows with their checks, passed, and failures: what each failed check says."""
    out = qa_rows(rows, cases.select("file", "backend", "min_chars", "golden_hash"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    said = {
        "extract_ok": F.col("error"),
        "min_chars_ok": F.concat(text("chars"), F.lit(" chars (min "), F.coalesce(F.col("min_chars"), F.lit(1)).cast("string"), F.lit(")")),
        "pages_ok": F.concat(text("pages"), F.lit(" pages")),
        "hash_ok": F.concat(F.lit("expected "), F.left("golden_hash", F.lit(12)), F.lit("… got "), F.coalesce(F.left("hash", F.lit(12)), F.lit("nothing"))),
    }
    fails = F.array(*[F.when(~F.col(c) & (F.lit(c == "extract_ok") | F.col("extract_ok")), F.concat(F.lit(c.removesuffix("_ok") + ": "), m)) for c, m in said.items()])
    return out.withColumn("failures", F.filter(fails, lambda x: x.isNotNull()))


def lines(rows: DataFrame, as_json: bool = False) -> DataFrame:
    """A line for each measured row, tab-separated or JSON."""
    if as_json:
        return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))
    good = F.concat_ws("\t", "file", "backend", F.concat_ws(" ", "chars", F.lit("chars")), F.concat_ws(" ", F.coalesce("pages", F.lit(0)), F.lit("pages")), F.concat_ws(" ", "elapsed_ms", F.lit("ms")))
    return rows.select(F.when(F.col("error").isNotNull(), F.concat_ws("\t", "file", "backend", F.lit("ERROR"), "error")).otherwise(good).alias("line"))


def html_report(rows: DataFrame, title: str = "Text extraction") -> Iterator[str]:
    """An HTML page of scored() rows in pieces, so that no more than a partition is held at a time."""
    total = qa_summary(rows).first()
    yield f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title>\n'
    yield "<style>body{font-family:sans-serif}td,th{border:1px solid #ccc;padding:4px 8px;text-align:left}table{border-collapse:collapse}.fail{color:#a00}.pass{color:#060}</style></head><body>\n"
    yield f"<h1>{html.escape(title)}</h1><p>Pass rate: {total['pass_rate']}% ({total['passed']} of {total['total']})</p>\n<table><tr><th>file</th><th>backend</th><th>result</th><th>extract</th><th>failures</th></tr>\n"
    for r in rows.orderBy("file", "backend").toLocalIterator():
        word = "pass" if r["passed"] else "fail"
        what = r["error"] if r["error"] is not None else f"{r['chars']} chars, {r['pages']} pages, {r['elapsed_ms']} ms, {r['method']}"
        cells = [r["file"], r["backend"], word, what, "; ".join(r["failures"])]
        yield f'<tr class="{word}">' + "".join(f"<td>{html.escape(str(c))}</td>" for c in cells) + "</tr>\n"
    yield "</table></body></html>\n"
