"""Outputs of jobs: exported texts, metadata, notices of ended jobs."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.rules import signature, webhook_error

#: Formats that are written as they are; the others need programs outside Spark.
PLAIN = ["md", "txt"]


def artifacts(**there: Column) -> Column:
    """Names of artifacts with whether a job has them."""
    return F.create_map(*[x for name, c in there.items() for x in (F.lit(name), F.coalesce(c, F.lit(False)))])


def write_texts(outputs: DataFrame, path: str, text: str = "markdown", key: str = "doc_id") -> None:
    """A folder for each job with its text in one file; a rerun of a job replaces its own folder only."""
    rows = outputs.select(key, F.coalesce(text, F.lit("")).alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).text(path)


def metadata(outputs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, metadata: a row's columns but its texts as JSON."""
    rest = [c for c in outputs.columns if c not in (key, "text", "markdown")]
    return outputs.select(key, F.to_json(F.struct(key, *rest), {"ignoreNullFields": "false"}).alias("metadata"))


def notices(jobs: DataFrame, url: str, secret: str | None = None, https_only: bool = False) -> DataFrame:
    """job_id, url, body, signature, error of ended jobs (job_id and more): what a webhook is sent, and why it is not."""
    job = F.struct(*jobs.columns)
    body = F.to_json(F.struct(F.lit("job.terminal").alias("event"), job.alias("job")), {"ignoreNullFields": "false"})
    signed = F.lit(None).cast("string") if secret is None else signature(body, F.lit(secret))
    return jobs.select("job_id", F.lit(url).alias("url"), body.alias("body"), signed.alias("signature"), webhook_error(F.lit(url), https_only).alias("error"))


def post(url: str, body: bytes, headers: dict[str, str], timeout: float = 30.0) -> None:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers, method="POST"), timeout=timeout) as answer:
            if answer.status >= 400:
                raise ConnectionError(f"HTTP {answer.status}")
    except urllib.error.URLError as e:
        raise ConnectionError(str(e)) from e


def deliver(rows: DataFrame, send: Callable[[str, bytes, dict[str, str]], None] = post, retries: int = 3, base: float = 1.0) -> DataFrame:
    """job_id, delivered, error of notices(); refused URLs are not called, failures are tried again with doubling pauses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                error = r.error
                headers = {"Content-Type": "application/json"} | ({"X-Signature": r.signature} if r.signature else {})
                for attempt in range(retries + 1) if not error else ():
                    try:
                        send(r.url, r.body.encode(), headers)
                        error = None
                        break
                    except ConnectionError as e:
                        error = f"WEBHOOK_FAILED: {e}"
                        if attempt < retries:
                            time.sleep(base * 2**attempt)
                out.append((r.job_id, error is None, error))
            yield pd.DataFrame(out, columns=["job_id", "delivered", "error"])

    return rows.mapInPandas(run, "job_id string, delivered boolean, error string")


