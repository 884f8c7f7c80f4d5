"""Programs outside Spark (converters, recognisers) as readers of files: a task gives a program one file's bytes, with a time limit.

A program that is absent, fails or takes too long makes an error row of its file and nothing else.
"""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import PATHS
from lexweave.sources.office import READERS
from lexweave.sources.tables import MAX_BYTES, glob_of

# Names that a program may have.
PROGRAMS = {"pandoc": ["pandoc"], "libreoffice": ["libreoffice", "soffice"], "tesseract": ["tesseract"], "imagemagick": ["magick", "convert"]}
SECONDS = 300.0
DETAIL_CHARS = 500

#: From a file's bytes to its text and the way it was read.
Reader = Callable[[bytes], tuple[str, str]]


def program(name: str) -> str | None:
    """The path of a program, or None."""
    return next((found for n in PROGRAMS[name] if (found := shutil.which(n))), None)


def required(name: str) -> str:
    found = program(name)
    if found is None:
        raise RuntimeError(f"{name} is not installed")
    return found


def run(command: list[str], label: str, seconds: float = SECONDS) -> str:
    """Standard output; a RuntimeError names the label and what the program said, without paths."""
    try:
        done = subprocess.run(command, capture_output=True, text=True, errors="replace", timeout=seconds)
    except subprocess.TimeoutExpired:
        raise RuntimeError(f"{label} took more than {seconds:g} s") from None
    if done.returncode:
        said = re.sub(PATHS, "<path>", done.stderr or done.stdout or "no message").strip()
        raise RuntimeError(f"{label} failed: {said[:DETAIL_CHARS]}")
    return done.stdout


def office_converted(content: bytes, suffix: str, to: str, seconds: float = SECONDS) -> bytes:
    """A file in another office format; each call has its own profile, as calls that share one refuse to run side by side."""
    office = required("libreoffice")
    with tempfile.TemporaryDirectory() as folder:
        source = Path(folder) / f"input.{suffix}"
        source.write_bytes(content)
        profile = f"-env:UserInstallation={(Path(folder) / 'profile').as_uri()}"
        run([office, profile, "--headless", "--convert-to", to, "--outdir", f"{folder}/out", str(source)], "office conversion", seconds)
        target = Path(folder) / "out" / f"input.{to}"
        if not target.exists():
            raise RuntimeError(f"office conversion gave no {to} file")
        return target.read_bytes()


def markdown_by_pandoc(suffix: str, seconds: float = SECONDS) -> Reader:
    def read(content: bytes) -> tuple[str, str]:
        pandoc = required("pandoc")
        with tempfile.TemporaryDirectory() as folder:
            source, target = Path(folder) / f"input.{suffix}", Path(folder) / "output.md"
            source.write_bytes(content)
            run([pandoc, str(source), "-t", "markdown", "--wrap=none", "-o", str(target)], "conversion to Markdown", seconds)
            return target.read_text(encoding="utf-8", errors="ignore"), "pandoc"

    return read


def first_of(*readers: Reader) -> Reader:
    """The first reader that does not fail; the last one's failure is the file's."""

    def read(content: bytes) -> tuple[str, str]:
        for reader in readers[:-1]:
            try:
                return reader(content)
            except RuntimeError:
                continue
        return readers[-1](content)

    return read


def legacy_word(seconds: float = SECONDS) -> Reader:
    """DOC files by pandoc, else as DOCX made by the office program."""

    def by_office(content: bytes) -> tuple[str, str]:
        with zipfile.ZipFile(io.BytesIO(office_converted(content, "doc", "docx", seconds))) as z:
            return READERS["docx"](z), "libreoffice+docx"

    return first_of(markdown_by_pandoc("doc", seconds), by_office)


def file_texts(spark: SparkSession, path: str, suffix: str, reader: Reader) -> DataFrame:
    """path, text, method, error of a folder's files with a suffix; files over the limit are not read."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"]):
                try:
                    rows.append((p, *reader(bytes(content)), None))
                except Exception as e:  # noqa: BLE001  whatever a reader of one file raises is that file's own
                    rows.append((p, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "text", "method", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob_of({suffix})).option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= MAX_BYTES).select("path", "content").mapInPandas(texts, "path string, text string, method string, error string")


def readers(spark: SparkSession, path: str, by_suffix: dict[str, Reader]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Readers in the form that ``files.extract`` takes as ``extra``; that folder has to be the same."""

    def one(suffix: str, reader: Reader) -> Callable[[DataFrame], DataFrame]:
        return lambda listed: file_texts(spark, path, suffix, reader).join(listed.select("path"), "path", "left_semi").select("path", "text", "error")

    return {suffix: one(suffix, reader) for suffix, reader in by_suffix.items()}
