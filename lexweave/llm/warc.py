"""WARC archives as a Spark sink and a Python data source.

Writing stays in the JVM: a record is built with SQL functions and written as a line whose separator is the blank
line that ends WARC records, so any store that Spark can write to will do.  Payloads of ``REVISIT_MIN_BYTES`` or
more that occur again are stored once; the other records revisit that one.

Reading is a Python data source.  ``partitions`` plans files into tasks; ``pushFilters`` takes predicates on the
record type and the other headers; the reader parses a record's headers first and seeks past the payload of a
record that the predicates reject.

Defined results: a null payload is the empty payload; a null or broken URL gives a record without target; equal
payloads under one page_id are all kept as responses; rows without a page_id never count as the largest.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from lexweave.llm.common import materialize, scratch_path

REVISIT_MIN_BYTES = 1000
#: Rows of repeated payloads (about 60 bytes each) up to which the table of repeats is broadcast.
BROADCAST_ROWS = 500_000
RECORD_ID = "urn:lexweave:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"

SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_length", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
#: Header of each column that predicates can be pushed to.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def mark_revisits(pages: DataFrame, key: str = "page_id", payload: str = "payload") -> DataFrame:
    """Adds digest (SHA-1 in hex), n_bytes and refers_to: the largest key with an equal payload, for the others of at least REVISIT_MIN_BYTES."""
    pages = pages.withColumns({"n_bytes": F.octet_length(payload).cast("long"), "digest": F.sha1(payload)})
    again = pages.where(F.col("n_bytes") >= REVISIT_MIN_BYTES).groupBy("digest", "n_bytes").agg(F.max(key).alias("holder"), F.count("*").alias("n")).where("n > 1 AND holder IS NOT NULL").drop("n")
    again = materialize(again, "warc-repeats")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    return pages.join(again, ["digest", "n_bytes"], "left").withColumn("refers_to", F.when(~F.col(key).eqNullSafe(F.col("holder")), F.col("holder"))).drop("holder")


def record_column(key: str, url: str, payload: str, digest: str, n_bytes: str, refers_to: str):
    """A WARC record without the blank line at its end."""
    head = lambda name, value: F.when(F.length(value) > 0, F.concat(F.lit(f"{name}: "), value, F.lit(EOL))).otherwise("")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    uri = F.coalesce(F.regexp_replace(F.col(url).cast("string"), r"[\x00-\x20\x7f]", ""), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col(n_bytes).cast("string"), F.lit(EOL * 2))
    again = F.col(refers_to).isNotNull()
    block = F.concat(http, F.when(again, "").otherwise(F.col(payload)))
    return F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit(f"{EOL}WARC-Record-ID: <{RECORD_ID}"),
        number(key),
        F.lit(f">{EOL}WARC-Date: 1970-01-01T00:00:00Z{EOL}"),
        head("WARC-Target-URI", uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col(digest), F.lit(EOL)),
        F.when(again, F.concat(F.lit(f"WARC-Refers-To: <{RECORD_ID}"), number(refers_to), F.lit(f">{EOL}WARC-Profile: {PROFILE}{EOL}"))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{EOL}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(EOL * 2),
        block,
    )


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", text: str = "html", compression: str = "none") -> None:
    """Writes one record for each row; the rows stay in their partitions, one archive each."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("payload"))
    rows = mark_revisits(rows)
    rows.select(record_column("page_id", "url", "payload", "digest", "n_bytes", "refers_to").alias("value")).write.option("lineSep", EOL * 2).option("compression", compression).text(path)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.task_bytes = int(options.get("taskbytes", 64 << 20))
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.equal: dict[str, set] = {}
        self.prefix: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo) and isinstance(f.value, str):
                self._allow(name, {f.value})
            elif name in HEADERS and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self._allow(name, set(f.value))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.prefix.append((name, f.value))
            elif name == "record_type" and isinstance(f, IsNotNull):
                pass  # every record has a type
            else:
                yield f

    def _allow(self, name: str, values: set) -> None:
        self.equal[name] = self.equal.get(name, values) & values

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = [fs.get_file_info(root)] if fs.get_file_info(root).type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size or 0) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))
        out: list[list[str]] = []
        room = 0
        for path, size in files:
            if room < size or not out:
                out.append([])
                room = self.task_bytes
            out[-1].append(path)
            room -= size
        return [_Files(p) for p in out] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            raw = fs.open_input_file(path)
            with io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 20) as f:
                for row in self._records(f):
                    rows.append(row)
                    held += len(row[-1] or b"") + 200
                    if held > 8 << 20:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _wanted(self, row: dict) -> bool:
        return all(row.get(k) in v for k, v in self.equal.items()) and all((row.get(k) or "").startswith(v) for k, v in self.prefix)

    def _records(self, f) -> Iterator[tuple]:
        while first := f.readline():
            if not first.strip():
                continue
            if not first.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {first[:80]!r}")
            head = _headers(f)
            size = int(head["content-length"])
            row = {k: _plain(k, head.get(h)) for k, h in HEADERS.items()}
            if not self._wanted(row):
                f.seek(size, 1)
                continue
            at = f.tell()
            inner = {}
            if head.get("content-type", "").startswith("application/http"):
                f.readline()
                inner = _headers(f)
            rest = size - (f.tell() - at)
            length, payload = int(inner.get("content-length", rest)), None
            if self.with_payload and row["record_type"] != "revisit":
                payload = f.read(rest)
            else:
                f.seek(rest, 1)
            yield (*row.values(), length, payload)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=SCHEMA.names)


def _headers(f) -> dict[str, str]:
    out = {}
    while (line := f.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _plain(column: str, value: str | None) -> str | None:
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.strip("<>")
    return value.removeprefix("sha1:") if column == "payload_digest" else value


class WarcDataSource(DataSource):
    """Options: path (a file or folder, by any URI that Arrow's file systems open), payload (false: headers only), taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(**options).load(path)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages (page_id, url, html) as archives in the shared folder and reads them back, a row for each record.

    Payload length and digest of a response are taken from the payload that was read; those of a revisit, which
    has none, from its headers.
    """
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("none")).cast("long")
    full = read_warc(spark, path).where("record_type = 'response'")
    full = full.select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), (F.sha1("payload") == F.col("payload_digest")).alias("intact"))
    again = read_warc(spark, path, payload="false").where("record_type = 'revisit'")
    again = again.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"), F.lit(True).alias("intact"))
    return full.unionByName(again)
