"""Text of zipped office files (DOCX, ODT, EPUB), read as binary files and parsed in Arrow batches.

Files over MAX_BYTES are not opened; a file that cannot be parsed gives a row with its error, never a failed job.
"""

from __future__ import annotations

import io
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.sources.tables import MAX_BYTES

# XML namespaces and part names of the formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ODF = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
MARKUP = {"h1": "\n\n# ", "h2": "\n\n## ", "h3": "\n\n### ", "h4": "\n\n#### ", "h5": "\n\n##### ", "h6": "\n\n###### ", "li": "\n- ", "br": "\n", "p": "\n\n", "div": "\n\n", "ul": "\n\n", "ol": "\n\n"}
HIDDEN = ("script", "style", "head")


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in HIDDEN
        self.out.append(MARKUP.get(tag, ""))

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in HIDDEN and self.hidden > 0
        self.out.append("\n\n" if tag in MARKUP and tag not in ("li", "br") else "")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(" ".join(data.split()) if not data.strip() else data)


def markdown_of_html(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    lines = [line.strip() for line in "".join(parser.out).split("\n")]
    out = [line for i, line in enumerate(lines) if line or (i and lines[i - 1])]
    return "\n".join(out).strip()


def _docx(z: zipfile.ZipFile) -> str:
    blocks = []
    for p in ElementTree.fromstring(z.read("word/document.xml")).iter(f"{WORD}p"):
        text = "".join({f"{WORD}t": e.text or "", f"{WORD}tab": "\t", f"{WORD}br": "\n"}.get(e.tag, "") for e in p.iter())
        style = p.find(f"{WORD}pPr/{WORD}pStyle")
        name = style.get(f"{WORD}val", "") if style is not None else ""
        level = int(name[7:]) if name.startswith("Heading") and name[7:].isdigit() else 0
        bullet = p.find(f"{WORD}pPr/{WORD}numPr") is not None
        if text.strip():
            blocks.append("#" * min(level, 6) + " " * bool(level) + "- " * (bullet and not level) + text.strip())
    return "\n\n".join(blocks)


def _odt(z: zipfile.ZipFile) -> str:
    blocks = []
    for e in ElementTree.fromstring(z.read("content.xml")).iter():
        if e.tag in (f"{ODF}p", f"{ODF}h") and (text := "".join(e.itertext()).strip()):
            blocks.append(("#" * min(6, int(e.get(f"{ODF}outline-level", "1"))) + " " if e.tag == f"{ODF}h" else "") + text)
    return "\n\n".join(blocks)


def _epub(z: zipfile.ZipFile) -> str:
    """Chapters in the order of the package's spine, else by name."""
    names = sorted(n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))
    package = next((n for n in z.namelist() if n.endswith(".opf")), None)
    if package:
        root = ElementTree.fromstring(z.read(package))
        folder = package.rpartition("/")[0]
        hrefs = {e.get("id"): "/".join(filter(None, (folder, e.get("href", "")))) for e in root.iter() if e.tag.endswith("}item")}
        spine = [hrefs.get(e.get("idref")) for e in root.iter() if e.tag.endswith("}itemref")]
        names = [n for n in spine if n in names] or names
    chapters = (markdown_of_html(z.read(n).decode("utf-8", "replace")) for n in names)
    return "\n\n".join(c for c in chapters if c)


READERS = {"docx": _docx, "odt": _odt, "epub": _epub}


def office_files(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, text, error of the DOCX, ODT and EPUB files under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{[dD][oO][cC][xX],[oO][dD][tT],[eE][pP][uU][bB]}").option("recursiveFileLookup", "true").load(path)

    @F.pandas_udf("text string, error string")
    def parse(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for p, content in zip(paths, contents):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows.append((READERS[p.rsplit(".", 1)[1].lower()](z), None))
            except Exception as e:  # noqa: BLE001  damaged and encrypted members fail in many ways, and are all this file's own
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    small = files.where(F.col("length") <= MAX_BYTES).select("path", F.col("length").alias("bytes"), parse("path", "content").alias("x")).select("path", "bytes", "x.text", "x.error")
    large = files.where(F.col("length") > MAX_BYTES).select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("text"), F.lit("too large").alias("error"))
    return small.unionByName(large)
