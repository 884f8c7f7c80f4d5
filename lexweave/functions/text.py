"""String functions of the document pipeline, as column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, prices and thresholds that results depend on.
LEGAL_PATTERNS = [
    r"(?i)\bwhereas\b", r"(?i)\bhereby\b", r"(?i)\bherein\b", r"(?i)\bthereof\b", r"(?i)\bindemnif", r"(?i)\bparty\b", r"(?i)\bparties\b", r"(?i)\bagreement\b", r"(?i)\bcontract\b",
    r"(?i)\bshall\b", r"(?i)\bliability\b", r"(?i)\bjurisdiction\b", r"(?i)\bgoverning law\b", r"(?i)\bwitnesseth\b",
]
SENTENCE_BOUNDARY = r"(?<=[.!?])\s+"
SECRET = r"(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*\S+"
BEARER = r"(?i)Bearer\s+\S+"
PATHS = r"(?:/[A-Za-z0-9_.@+-]+){2,}|(?:[A-Za-z]:\\)[^\s]+"
PROTECTED = r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b|\b\d+(?:[.,]\d+)?%|\$\s?\d+(?:[.,]\d+)?|\b\d+(?:[.,]\d+)?\b"
PROPER_NOUNS = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
SLIDE_MARKER = r"(?m)^\s*--\s*0*(\d+)\s+of\s+\d+\s*--\s*$"


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used: expressions are trees, and repeats multiply in them."""
    return F.transform(F.array(value), use)[0]


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """Line ends to LF, white space at both ends gone, a final LF."""
    return F.concat(stripped(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))), F.lit("\n"))


def source_hash(text: Column) -> Column:
    return F.sha2(stripped(normalize(text)), 256)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(stripped(text), SENTENCE_BOUNDARY), stripped), lambda s: s != "")


def legal_hits(text: Column) -> Column:
    """How many of the legal patterns occur.  Lower-cased text that lacks a pattern's letters is not searched for it."""

    def count(low: Column) -> Column:
        total = F.lit(0)
        for p in LEGAL_PATTERNS:
            letters = p.removeprefix("(?i)").replace(r"\b", "")
            total = total + (F.contains(low, F.lit(letters)) & F.regexp_like(text, F.lit(p))).cast("int")
        return total

    return let(F.lower(text), count)


def legal_class(hits: Column) -> Column:
    return F.when(hits >= 3, "legal").when(hits == 0, "other").otherwise("ambiguous")


def token_estimate(text: Column) -> Column:
    """A quarter of the stripped length, rounded up."""
    return F.ceil(F.length(stripped(text)) / 4).cast("long")


def protected_tokens(text: Column) -> Column:
    """The distinct dates, percentages, amounts, numbers and names, sorted."""
    both = F.concat(F.regexp_extract_all(text, F.lit(PROTECTED), 0), F.regexp_extract_all(text, F.lit(PROPER_NOUNS), 0))
    return F.array_sort(F.array_distinct(both))


def redact_secrets(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SECRET, "<redacted>"), BEARER, "<redacted>")


def mask_paths(text: Column, most: int = 500) -> Column:
    masked = F.regexp_replace(text, PATHS, "<path>")
    return F.when(F.length(masked) > most, F.concat(F.substring(masked, 1, most), F.lit("..."))).otherwise(masked)


def slide_markers(text: Column) -> Column:
    return F.concat(stripped(F.regexp_replace(text, SLIDE_MARKER, "--- Slide $1 ---")), F.lit("\n"))


def language_code(code: Column) -> Column:
    """The code in lower case, or null if it is not two letters."""
    c = F.lower(F.trim(code))
    return F.when(c.rlike("^[a-z]{2}$"), c)


def severity(value: Column) -> Column:
    v = F.lower(value)
    return F.when(v.isin("low", "medium", "high", "breaking"), v).otherwise("medium")


def longer_variant(a: Column, b: Column) -> Column:
    return F.when(F.length(a) >= F.length(b), a).otherwise(b)


def cover_and_body(cover: Column, body: Column, fmt: Column) -> Column:
    """The exported Markdown: cover, a break that the format knows, body."""
    return (
        F.when(cover.isNull(), body)
        .when(fmt.isin("txt", "md"), F.concat(cover, F.lit("\n\n---\n\n"), body))
        .when(fmt == "pdf", F.concat(F.lit('<div class="cover-page">\n\n'), cover, F.lit("\n\n</div>\n\n"), body))
        .otherwise(F.concat(cover, F.lit("\n\n\\newpage\n\n"), body))
    )
