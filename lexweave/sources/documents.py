"""A folder of documents as a data source that opens only the files a query wants.

``register(spark)`` makes ``spark.read.format("document_files").option("path", uri)`` known: path, suffix, bytes, page, pages, content.  Conditions on suffix, bytes and
path decide from the folder's listing, before a partition is planned; files are packed into partitions of about ``taskbytes`` bytes, so many
small files are one task and a large one has its own.  Text files have a page after each form feed, of which only those of a pushed page
range leave the reader; other files are page 1.  With ``content`` false no file is opened and ``pages`` is null: a listing.  A
file that cannot be read gives a row without content and with its ``error``.

Set ``spark.sql.python.filterPushdown.enabled`` to true: Spark refuses sources that take conditions where it is false.  load() the source for each query:
Spark 4.1 keeps what the first query of a loaded table has pushed for its later ones.  Folders are those that pyarrow
opens (local, s3, gs, hdfs).  Names that begin with _ or . are no documents.  An empty folder has no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith,
)

SCHEMA = "path string, suffix string, bytes long, page int, pages int, content binary, error string"
TASK_BYTES = 64 << 20
PAGED = {"txt", "md", "markdown"}
LISTED = {"path", "suffix", "bytes"}
_MOST = 2**63 - 1


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]  # path, bytes

    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)
        self.files = files


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


@dataclass
class Span:
    """The whole numbers from low to high."""

    low: int = -_MOST
    high: int = _MOST

    def cut(self, f: Filter) -> bool:
        """Takes a condition in; False where it is none of numbers."""
        v = getattr(f, "value", None)
        if isinstance(v, bool) or not isinstance(v, int):
            return False
        low, high = {EqualTo: (v, v), GreaterThan: (v + 1, _MOST), GreaterThanOrEqual: (v, _MOST), LessThan: (-_MOST, v - 1), LessThanOrEqual: (-_MOST, v)}.get(type(f), (None, None))
        if low is None:
            return False
        self.low, self.high = max(self.low, low), min(self.high, high)
        return True

    def __contains__(self, n: int) -> bool:
        return self.low <= n <= self.high


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.task_bytes = options["path"], int(options.get("taskbytes", TASK_BYTES))
        self.with_content = options.get("content", "true").lower() != "false"
        self.numbers = {"bytes": Span(), "page": Span(1)}
        self.among: list[tuple[str, set[str]]] = []
        self.begins: list[tuple[str, str]] = []
        self.ends: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            texts = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name in self.numbers and self.numbers[name].cut(f):
                continue
            if name in ("path", "suffix") and texts is not None and all(isinstance(v, str) for v in texts):
                self.among.append((name, texts))
            elif name in ("path", "suffix") and isinstance(f, StringStartsWith):
                self.begins.append((name, f.value))
            elif name in ("path", "suffix") and isinstance(f, StringEndsWith):
                self.ends.append((name, f.value))
            elif not (name in LISTED | {"page"} and isinstance(f, IsNotNull)):
                yield f

    def _wanted(self, path: str, size: int) -> bool:
        own = {"path": path, "suffix": suffix_of(path)}
        named = all(own[n] in v for n, v in self.among) and all(own[n].startswith(v) for n, v in self.begins) and all(own[n].endswith(v) for n, v in self.ends)
        first = suffix_of(path) in PAGED or 1 in self.numbers["page"]
        return named and size in self.numbers["bytes"] and first and self.numbers["page"].high >= 1

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        listed = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((i.path, i.size or 0) for i in listed if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
        parts, room = [], 0
        for path, size in files:
            if not self._wanted(path, size):
                continue
            if not parts or size > room:
                parts.append([])
                room = self.task_bytes
            parts[-1].append((path, size))
            room = max(0, room - size)
        return [Files(p) for p in parts] or [Files([])]

    def _open(self, store: fs.FileSystem, path: str) -> bytes:
        with store.open_input_stream(path) as f:
            return f.read()

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        pages = self.numbers["page"]
        for path, size in partition.files:
            kind = suffix_of(path)
            if not self.with_content:
                if 1 in pages:
                    yield path, kind, size, 1, None, None, None
                continue
            try:
                content = self._open(store, path)
            except OSError as e:
                if 1 in pages:
                    yield path, kind, size, 1, None, None, str(e)
                continue
            parts = content.split(b"\f") if kind in PAGED else [content]
            for i in range(max(1, pages.low), min(len(parts), pages.high) + 1):
                yield path, kind, size, i, len(parts), parts[i - 1], None


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFiles)
