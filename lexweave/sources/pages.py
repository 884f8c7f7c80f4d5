"""Pages of documents: native and recognised text, layouts with text items, and their statistics."""

from __future__ import annotations

import json
import tempfile
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.rules import layout_text
from lexweave.functions.text import slide_markers, stripped
from lexweave.operators.jobs import OCR_BELOW, page_text
from lexweave.sources.programs import required, run
from lexweave.sources.tables import MAX_BYTES, glob_of

# Names that layouts use, as fields and under older spellings.
ITEM = "text: string, x: double, y: double, width: double, height: double, font_name: string, font_size: double, confidence: double"
RAW_PAGE = f"page_num: int, page_number: int, width: double, page_width: double, height: double, page_height: double, text: string, text_items: array<struct<{ITEM}>>, textItems: array<struct<{ITEM}>>"
LAYOUT_ONLY = ["target_pages", "pdf_password", "extract_dpi", "extract_screenshots", "preserve_layout"]
PAGE = "path string, page_num int, native string, image binary, error string"

#: From a document's bytes and a resolution to its pages' native texts and, for the pages that need one, images.
Opener = Callable[[bytes, int], Iterator[tuple[str, Callable[[], bytes]]]]


def pymupdf(content: bytes, dpi: int) -> Iterator[tuple[str, Callable[[], bytes]]]:
    """Pages by PyMuPDF, where it is installed."""
    try:
        import fitz
    except ImportError:
        raise RuntimeError("PyMuPDF is not installed") from None
    with fitz.open(stream=content, filetype="pdf") as document:
        for page in document:
            yield page.get_text(), lambda page=page: page.get_pixmap(dpi=dpi).tobytes("png")


def pdf_pages(spark: SparkSession, path: str, opener: Opener = pymupdf, dpi: int = 150, images: bool = True) -> DataFrame:
    """path, page_num, native, image, error: a row per page; a sparse page has its image, if ``images``; a file that cannot be read is one row."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                try:
                    for number, (text, image) in enumerate(opener(bytes(content), dpi), 1):
                        sparse = images and len(text.strip()) < OCR_BELOW
                        yield pd.DataFrame([(p, number, text, image() if sparse else None, None)], columns=["path", "page_num", "native", "image", "error"])
                except Exception as e:  # noqa: BLE001  a damaged file is an error row
                    yield pd.DataFrame([(p, None, None, None, str(e) or type(e).__name__)], columns=["path", "page_num", "native", "image", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob_of({"pdf"})).option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= MAX_BYTES).select("path", "content").mapInPandas(pages, PAGE)


def multipart(fields: dict[str, str], name: str, filename: str, content: bytes, kind: str) -> tuple[bytes, str]:
    """Body and content type of a form with one file."""
    mark = uuid.uuid4().hex
    parts = [(f'form-data; name="{k}"', "", v.encode()) for k, v in fields.items()]
    parts.append((f'form-data; name="{name}"; filename="{filename}"', f"Content-Type: {kind}\r\n", content))
    body = b"".join(f"--{mark}\r\nContent-Disposition: {head}\r\n{extra}\r\n".encode() + value + b"\r\n" for head, extra, value in parts)
    return body + f"--{mark}--\r\n".encode(), f"multipart/form-data; boundary={mark}"


def recognise_over_http(url: str, language: str = "en", seconds: float = 30.0) -> Callable[[bytes], str]:
    """A recogniser that posts an image and joins the lines of the answer's results."""

    def recognise(image: bytes) -> str:
        body, kind = multipart({"language": language}, "file", "page.png", image, "image/png")
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data=body, headers={"Content-Type": kind}, method="POST"), timeout=seconds) as got:
                answer = json.loads(got.read())
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"HTTP {e.code}: {e.read()[:500].decode('utf-8', 'replace')}") from None
        except (OSError, ValueError) as e:
            raise RuntimeError(f"no answer: {e}") from None
        if not isinstance(answer, dict) or "error" in answer or not isinstance(answer.get("results"), list):
            raise RuntimeError(str(answer["error"]) if isinstance(answer, dict) and "error" in answer else "the answer has no results")
        lines = (str(r.get("text", "")).strip() for r in answer["results"])
        return "\n".join(line for line in lines if line)

    return recognise


def recognise_by_tesseract(languages: str = "eng", seconds: float = 300.0) -> Callable[[bytes], str]:
    def recognise(image: bytes) -> str:
        with tempfile.NamedTemporaryFile(suffix=".png") as f:
            f.write(image)
            f.flush()
            return run([required("tesseract"), f.name, "stdout", "-l", languages], "recognition", seconds)

    return recognise


def recognised(pages: DataFrame, recognise: Callable[[bytes], str], method: str) -> DataFrame:
    """Pages with ocr, method and warning; pages without an image are left as they are, failures become warnings.

    Pages are spread over the tasks by file and page, as one scanned document may have most of them.
    """

    @F.pandas_udf("ocr string, warning string")
    def read(images: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        rows = []
        for image, number in zip(images, numbers):
            try:
                rows.append((None if image is None else recognise(bytes(image)), None))
            except Exception as e:  # noqa: BLE001  one page's failure is a warning
                rows.append((None, f"OCR failed for page {int(number)}: {e}"))
        return pd.DataFrame(rows, columns=["ocr", "warning"])

    spread = pages.repartition(F.col("path"), F.col("page_num")).withColumn("r", read("image", "page_num"))
    return spread.select(*[c for c in pages.columns if c != "image"], "r.ocr", "r.warning", F.lit(method).alias("method"))


def page_rows(pages: DataFrame) -> DataFrame:
    """path, page_num, text, char_count, ocr, method, warning of pages (path, page_num, native, ocr, method, warning): what each page counts for."""
    used = ~page_text(F.col("native"), F.col("ocr")).eqNullSafe(F.col("native"))
    text = page_text(F.col("native"), F.col("ocr"))
    return pages.select("path", "page_num", text.alias("text"), F.length(stripped(F.coalesce(text, F.lit("")))).alias("char_count"), used.alias("ocr"), F.when(used, F.col("method")).otherwise("native").alias("method"), "warning")


def documents_of_pages(rows: DataFrame) -> DataFrame:
    """path, text, pages, ocr_pages, warnings of page_rows(): pages in their order, one line break between them, slide markers as headings."""
    one = F.array_sort(F.collect_list(F.struct("page_num", F.coalesce("text", F.lit("")).alias("text"), "warning")))
    out = rows.groupBy("path").agg(one.alias("p"), F.count_if("ocr").alias("ocr_pages"))
    text = slide_markers(F.array_join(F.transform("p", lambda x: x["text"]), "\n"))
    return out.select("path", text.alias("text"), F.size("p").alias("pages"), "ocr_pages", F.filter(F.transform("p", lambda x: x["warning"]), lambda x: x.isNotNull()).alias("warnings"))


def layout_pages(raw: Column) -> Column:
    """Pages (page_num, width, height, text, text_items) of a layout's JSON, under either spelling of its fields."""
    found = F.from_json(raw, f"pages array<struct<{RAW_PAGE}>>")["pages"]
    return F.transform(found, lambda p: F.struct(
        F.coalesce(p["page_num"], p["page_number"]).alias("page_num"), F.coalesce(p["width"], p["page_width"]).alias("width"), F.coalesce(p["height"], p["page_height"]).alias("height"),
        F.coalesce(p["text"], F.lit("")).alias("text"), F.coalesce(p["text_items"], p["textItems"], F.from_json(F.lit("[]"), f"array<struct<{ITEM}>>")).alias("text_items"),
    ))


def layout_json(pages: Column) -> Column:
    return F.to_json(F.struct(pages.alias("pages")), {"ignoreNullFields": "false"})


def _recognised_items(page: Column) -> Column:
    return F.exists(page["text_items"], lambda i: i["confidence"].isNotNull())


def layout_stats(pages: Column, method: str = "layout") -> Column:
    """page_num, char_count, ocr (an item has a confidence), text_item_count, method of every page."""
    return F.transform(pages, lambda p: F.struct(p["page_num"].alias("page_num"), F.length(p["text"]).alias("char_count"), _recognised_items(p).alias("ocr"), F.size(p["text_items"]).alias("text_item_count"), F.lit(method).alias("method")))


def layout_ocr_pages(pages: Column) -> Column:
    return F.size(F.filter(pages, _recognised_items))


def text_of_layout(pages: Column) -> Column:
    """Pages' texts, a blank line between them; null where all are blank."""
    return F.nullif(layout_text(F.transform(pages, lambda p: p["text"])), F.lit(""))


def reader_options(settings: dict[str, object]) -> dict[str, object]:
    """The settings that a layout reader takes, under its names; unset ones are left out."""
    names = {"ocr_enabled": "pdf_ocr", "ocr_language": "pdf_ocr_languages", "ocr_server_url": "pdf_ocr_server_url", "target_pages": "target_pages", "password": "pdf_password", "dpi": "extract_dpi"}
    return {new: settings[old] for new, old in names.items() if settings.get(old) not in (None, "")}


def ignored_options(backend: Column, settings: dict[str, Column]) -> Column:
    """Names of the settings that only the layout backend heeds and that are set for another one, in their order."""
    on = lambda c: F.coalesce(~F.lower(c.cast("string")).isin("", "false"), F.lit(False))
    named = F.array(*[F.when(on(settings[n]), F.lit(n)) for n in LAYOUT_ONLY if n in settings])
    return F.when(backend == "layout", F.array().cast("array<string>")).otherwise(F.filter(named, lambda n: n.isNotNull()))
