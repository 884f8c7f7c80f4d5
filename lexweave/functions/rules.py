"""Rules of options, files and jobs as column expressions: small decisions that the service makes about each row."""

import hashlib
import hmac
import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.formats import DEFAULT_PROVIDER, IMAGE_SUFFIXES, OFFICE_SUFFIXES, PRICES, selector, suffix
from lexweave.functions.text import stripped

# Patterns, blocked networks and hosts, names of options.
JOB_ID = r"^[a-zA-Z0-9_-]{1,128}\n?$"
BLOCKED = ["127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "::1/128", "fc00::/7", "fe80::/10"]
LOCAL_HOSTS = ["localhost", "localhost.localdomain"]
SEVERITIES = ["debug", "info", "warn", "error"]
HTTP_DATE = "dd MMM yyyy HH:mm:ss"


def job_id_ok(job: Column) -> Column:
    return F.coalesce(F.regexp_like(job, F.lit(JOB_ID)), F.lit(False))


def job_ids_error(ids: Column, inputs: Column) -> Column:
    """Why an array of job ids does not fit a number of inputs; null if it does."""
    return F.when(F.size(ids) != inputs, "count").when(F.size(F.array_distinct(ids)) != F.size(ids), "duplicate").when(F.exists(ids, lambda x: ~job_id_ok(x)), "invalid")


def _ip_number(host: Column) -> Column:
    """A dotted IPv4 address as a number, else null."""
    parts = F.split(host, r"\.")
    ok = host.rlike(r"^(?:(?:0|[1-9]\d{0,2})\.){3}(?:0|[1-9]\d{0,2})$") & F.forall(parts, lambda p: F.try_to_number(p, F.lit("999")) <= 255)
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p.cast("long")))


def blocked_address(host: Column) -> Column:
    """Whether a literal address lies in a blocked network; IPv6 by its leading group."""
    number, out = _ip_number(host), F.lit(False)
    bare = F.lower(F.regexp_replace(host, r"^\[|\]$", ""))
    for network in map(ipaddress.ip_network, BLOCKED):
        if network.version == 4:
            out = out | F.coalesce(number.between(int(network[0]), int(network[-1])), F.lit(False))
    first = F.conv(F.nullif(F.regexp_extract(bare, r"^([0-9a-f]{1,4}):", 1), F.lit("")), 16, 10).cast("long")
    in_range = lambda low, high: F.coalesce(first.between(low, high), F.lit(False))
    return out | (bare.rlike(r"^(?:0*:)*:?(?:0*:)*0*1$") & F.contains(bare, F.lit(":"))) | in_range(0xFC00, 0xFDFF) | in_range(0xFE80, 0xFEBF)


def webhook_error(url: Column, https_only: bool = False, resolved: Column | None = None) -> Column:
    """Why a webhook's URL is refused, or null; ``resolved`` holds the addresses that the caller's resolver gave, if it has asked one."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    out = F.when(F.lit(https_only) & (scheme != "https"), "scheme").when(~scheme.isin("http", "https"), "scheme").when(host == "", "host")
    out = out.when(host.isin(*LOCAL_HOSTS), "localhost").when(blocked_address(host), "address")
    return out if resolved is None else out.when(F.exists(resolved, blocked_address), "address").when(F.size(resolved) == 0, "unresolved")


def _signed(bodies: pd.Series, secrets: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or not s else "sha256=" + hmac.new(s.encode(), b.encode(), hashlib.sha256).hexdigest() for b, s in zip(bodies, secrets)], dtype="object")


def signature(body: Column, secret: Column) -> Column:
    """sha256=<hex> of HMAC-SHA256, which has no built-in function."""
    return F.pandas_udf(_signed, "string")(body, secret)


def retry_after(value: Column, now: Column | None = None) -> Column:
    """Seconds that a Retry-After header asks for (a number or an HTTP date), at least 0; null if it says nothing."""
    v = stripped(value)
    now = F.current_timestamp() if now is None else now
    seconds = F.when(v.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), v.cast("double"))
    # The weekday says nothing more; times are UTC, as the session's time zone has to be.
    date = F.try_to_timestamp(F.nullif(F.regexp_extract(v, r"^[A-Z][a-z]{2}, (\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("")), F.lit(HTTP_DATE))
    return F.greatest(F.lit(0.0), F.coalesce(seconds, F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double")) + F.when(seconds.isNull() & date.isNull(), F.lit(None).cast("double")).otherwise(0.0)


def retry_delay(attempt: Column, hint: Column, base: float = 1.0, most: float = 120.0) -> Column:
    return F.least(F.coalesce(hint, F.lit(base) * F.pow(F.lit(2.0), attempt)), F.lit(most))


def selector_ok(value: Column) -> Column:
    """Whether a selector names a model of the catalogue; the default provider takes any model."""
    full = selector(value)
    return F.coalesce(full.startswith(DEFAULT_PROVIDER + ":") | full.isin(*PRICES), F.lit(False))


def body_text(text: Column, layout: Column, preserve_layout: Column) -> Column:
    return F.when(preserve_layout & (stripped(layout) != ""), layout).otherwise(text)


def skip_translation(no_translate: Column, source: Column, target: Column) -> Column:
    return no_translate | F.coalesce(source == target, F.lit(False))


def translate_cover(target: Column, no_translate: Column) -> Column:
    return (target != "en") & ~no_translate


def resume_error(saved: dict[str, Column], asked: dict[str, Column]) -> Column:
    """The first of llm, mode, target_lang and source_hash in which a checkpoint differs from the job, or null."""
    out = F.when(F.lit(False), "")
    for name in ("llm", "mode", "target_lang", "source_hash"):
        out = out.when(~saved[name].eqNullSafe(asked[name]), name)
    return out


def checkpoint_name(pass_num: Column, index: Column, meta: bool = False) -> Column:
    return F.format_string("translate-pass%d-chunk-%04d" + (".meta.json" if meta else ".md"), pass_num, index)


def source_chunk_name(index: Column) -> Column:
    return F.format_string("chunk-%04d.md", index)


def page_name(number: Column) -> Column:
    return F.format_string("page-%04d.png", number)


def merged_lines(texts: Column) -> Column:
    """Recognised lines, stripped, without blank ones, a line each."""
    return F.array_join(F.filter(F.transform(texts, stripped), lambda t: t != ""), "\n")


def layout_text(pages: Column) -> Column:
    """Pages' texts, stripped, without blank ones, a blank line between them."""
    return F.array_join(F.filter(F.transform(pages, stripped), lambda t: t != ""), "\n\n")


def report_severities(value: Column) -> Column:
    """The severities of a comma-separated list, without repeats, in its order; warning is warn; error where none is known."""
    each = F.transform(F.split(value, ","), lambda x: F.lower(stripped(x)))
    known = F.array_distinct(F.filter(F.transform(each, lambda x: F.when(x == "warning", "warn").otherwise(x)), lambda x: x.isin(*SEVERITIES)))
    return F.when(F.size(F.coalesce(known, F.array().cast("array<string>"))) > 0, known).otherwise(F.array(F.lit("error")))


def backend(path: Column, asked: Column) -> Column:
    """The extraction backend (auto: by suffix); null where the asked one cannot read the file."""
    layout = suffix(path).isin(*OFFICE_SUFFIXES, *IMAGE_SUFFIXES)
    return F.when(asked == "auto", F.when(layout, "layout").otherwise("native")).when((asked == "native") & layout, F.lit(None)).otherwise(asked)


def ocr_workers(asked: Column, cpus: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(asked, F.least(F.lit(4), cpus - 1)))


def extracted_markdown(meta: Column, body: Column) -> Column:
    """Extracted text under a JSON front matter; ``meta`` is a struct."""
    return F.concat(F.lit("---\n"), F.to_json(meta), F.lit("\n---\n\n"), F.regexp_replace(body, r"(?U)\s+$", ""), F.lit("\n"))
