"""Exported files of translated Markdown in nine formats; a program that is absent or fails makes an error row."""

from __future__ import annotations

import importlib.util
import os
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from lexweave.functions.formats import OWN_FORMAT, RIGHT_TO_LEFT
from lexweave.sources.programs import SECONDS, office_converted, required, run

STYLE = """@page { size: A4; margin: 2.2cm; }
body { font-family: "DejaVu Serif", serif; font-size: 11pt; line-height: 1.45; }
h1, h2, h3 { break-after: avoid; }
pre, code { font-family: "DejaVu Sans Mono", monospace; font-size: 9.5pt; white-space: pre-wrap; }
table { border-collapse: collapse; width: 100%; }
th, td { border: 0.5pt solid #888; padding: 3pt 5pt; }
.cover-page { break-after: page; }
"""
RTL_STYLE = STYLE + 'body { direction: rtl; text-align: right; font-family: "Noto Naskh Arabic", "DejaVu Sans", sans-serif; }\nth, td { text-align: right; }\n'

#: From Markdown, format and language to the file's bytes.
Converter = Callable[[str, str, str | None], bytes]


def converted(markdown: str, fmt: str, lang: str | None = None, seconds: float = SECONDS) -> bytes:
    """Markdown as it is, everything else by pandoc: PDF with a print style, DOC through DOCX."""
    if fmt not in OWN_FORMAT:
        raise ValueError(f"unknown format: {fmt}")
    if fmt == "md":
        return markdown.encode()
    if fmt == "doc":
        return office_converted(converted(markdown, "docx", lang, seconds), "docx", "doc", seconds)
    pandoc = required("pandoc")
    if fmt == "pdf" and importlib.util.find_spec("weasyprint") is None:
        raise RuntimeError("weasyprint is not installed")
    to_left = (lang or "").strip().lower() in RIGHT_TO_LEFT
    with tempfile.TemporaryDirectory() as folder:
        source, style, target = (Path(folder) / n for n in ("input.md", "style.css", f"output.{fmt}"))
        source.write_text(markdown, encoding="utf-8")
        style.write_text(RTL_STYLE if to_left else STYLE, encoding="utf-8")
        extra = ["--pdf-engine=weasyprint", "--css", str(style)] if fmt == "pdf" else ["-f", "markdown+raw_tex"]
        extra += ["--metadata", f"lang={lang}"] if lang and fmt != "pdf" else []
        extra += ["--css", str(style)] if fmt == "html" and to_left else []
        run([pandoc, str(source), "-o", str(target), "--standalone", *extra], f"export to {fmt}", seconds)
        return target.read_bytes()


def exported(rows: DataFrame, convert: Converter = converted) -> DataFrame:
    """name, format, content, error of rows (name, markdown, format, lang)."""

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                content, error = None, None
                try:
                    content = convert(r.markdown or "", r.format, r.lang)
                except (RuntimeError, ValueError, OSError) as e:
                    error = str(e)
                yield pd.DataFrame([(r.name, r.format, content, error)], columns=["name", "format", "content", "error"])

    return rows.select("name", "markdown", "format", "lang").mapInPandas(files, "name string, format string, content binary, error string")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes exported() as <folder>/<name>.<format> and gives name, path, bytes, error.

    The folder is one that all executors mount.  A file appears whole under its name, and a task that runs again replaces it.
    Names that would leave the folder are refused.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = Path(folder).resolve()
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                target = (root / f"{r.name}.{r.format}").resolve()
                error = r.error if r.error or root in target.parents else "name leaves the folder"
                if not error:
                    target.parent.mkdir(parents=True, exist_ok=True)
                    handle, part = tempfile.mkstemp(dir=target.parent, prefix=".part-")
                    with os.fdopen(handle, "wb") as f:
                        f.write(bytes(r.content))
                    os.replace(part, target)
                out.append((r.name, None if error else str(target), None if error else len(r.content), error))
            yield pd.DataFrame(out, columns=["name", "path", "bytes", "error"]).astype({"bytes": "Int64"})

    return files.mapInPandas(write, "name string, path string, bytes long, error string")
