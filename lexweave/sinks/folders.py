"""Job folders as a transactional sink: files of jobs appear together or not at all.

``df.write.format("job_folders").mode("append").option("path", uri).option("run", name).save()`` takes rows (job_id, name, content as text or bytes).  Each
attempt of a task writes under ``data/<run>/<write>/<attempt>/<job_id>/<name>`` and tells the driver only its attempt and counts.  The commit writes
``manifests/<run>.json``, which names the attempts that count: this one file is the transaction, nothing is renamed, and what other attempts left is
removed.  An abort removes the write's data, and its folder: where folders are real, tasks that still run cannot write any more.  A run of the same name replaces the earlier one, so a rerun equals one run.  Without
``run`` each write has a name of its own.  ``spark.read.format("job_folders")`` reads what the manifests name, with an attempt a partition.

Rows whose job id or file name is not plain (``JOB_ID``, ``NAME``) fail the write.  A file that one attempt writes twice keeps its last content.
``register(spark)`` makes the format known; folders are those that pyarrow opens (local, s3, gs, hdfs).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "job_id string, name string, content binary"
JOB_ID = re.compile(r"[A-Za-z0-9_-]{1,128}")
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,254}")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(uri)
    return store, path.rstrip("/")


def _remove(store: fs.FileSystem, path: str) -> None:
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)


def _listed(store: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    return store.get_file_info(fs.FileSelector(path, allow_not_found=True))


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int
    size: int


class FolderWriter(DataSourceWriter):
    def __init__(self, uri: str, run: str):
        if not JOB_ID.fullmatch(run):
            raise ValueError(f"no run's name: {run!r}")
        self.uri, self.run, self.made = uri, run, f"write-{uuid.uuid4().hex[:12]}"
        store, root = _open(uri)
        store.create_dir(f"{root}/data/{run}/{self.made}")

    def write(self, iterator: Iterator) -> Written:
        store, root = _open(self.uri)
        task = TaskContext.get()
        attempt, files, size, made = f"{self.made}/{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", 0, 0, set()
        for row in iterator:
            job, name, content = row["job_id"], row["name"], row["content"]
            if not JOB_ID.fullmatch(job or "") or not NAME.fullmatch(name or ""):
                raise ValueError(f"no plain job and file name: {job!r}, {name!r}")
            folder = f"{root}/data/{self.run}/{attempt}/{job}"
            if job not in made:
                if not made:  # fails where an abort has removed the write's folder: a killed task runs on for a while
                    store.create_dir(f"{root}/data/{self.run}/{attempt}", recursive=False)
                store.create_dir(folder, recursive=False)
                made.add(job)
            data = content.encode("utf-8") if isinstance(content, str) else bytes(content or b"")
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write(data)
            files, size = files + 1, size + len(data)
        return Written(attempt, files, size)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.uri)
        good = [m for m in messages if m is not None and m.files]
        store.create_dir(f"{root}/manifests")
        manifest = {"run": self.run, "attempts": sorted(m.attempt for m in good), "files": sum(m.files for m in good), "bytes": sum(m.size for m in good)}
        with store.open_output_stream(f"{root}/manifests/{self.run}.json") as f:
            f.write(json.dumps(manifest).encode())
        counted = set(manifest["attempts"])
        for left in _listed(store, f"{root}/data/{self.run}"):
            if left.base_name != self.made or not counted:
                _remove(store, left.path)
        for left in _listed(store, f"{root}/data/{self.run}/{self.made}"):
            if f"{self.made}/{left.base_name}" not in counted:
                _remove(store, left.path)

    def abort(self, messages: list[Written | None]) -> None:
        """Only what this write made goes: attempts that a manifest of an earlier run of this name counts stay."""
        store, root = _open(self.uri)
        kept = {a.partition("/")[0] for a in manifest_of(self.uri, self.run).get("attempts", [])}
        for left in _listed(store, f"{root}/data/{self.run}"):
            if left.base_name not in kept:
                _remove(store, left.path)
        if not kept:
            _remove(store, f"{root}/data/{self.run}")


def manifest_of(uri: str, run: str) -> dict:
    store, root = _open(uri)
    path = f"{root}/manifests/{run}.json"
    if store.get_file_info(path).type != fs.FileType.File:
        return {}
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


class FolderReader(DataSourceReader):
    def __init__(self, uri: str, run: str | None):
        self.uri, self.run = uri, run

    def partitions(self) -> list[InputPartition]:
        store, root = _open(self.uri)
        runs = [self.run] if self.run else sorted(i.base_name[:-5] for i in _listed(store, f"{root}/manifests") if i.base_name.endswith(".json"))
        return [InputPartition((run, a)) for run in runs for a in manifest_of(self.uri, run).get("attempts", [])] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        store, root = _open(self.uri)
        run, attempt = partition.value
        for folder in _listed(store, f"{root}/data/{run}/{attempt}"):
            for file in _listed(store, folder.path):
                with store.open_input_stream(file.path) as f:
                    yield folder.base_name, file.base_name, f.read()


class JobFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "job_folders"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options["path"], self.options.get("run") or uuid.uuid4().hex)

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], self.options.get("run"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JobFolders)


def files_of(outputs: DataFrame, job: Column | None = None) -> DataFrame:
    """job_id, name, content of jobs' outputs (doc_id, status, text, markdown and whatever else): status.json, and translated.md of those with a text.

    Ids become plain: other characters than letters, digits, - and _ turn into _, with a digest of the id behind them where that changed it.
    """
    given = (F.col("doc_id") if job is None else job).cast("string")
    plain = F.regexp_replace(given, r"[^A-Za-z0-9_-]", "_")
    name = F.when((plain == given) & (F.length(given) <= 128), given).otherwise(F.concat(F.left(plain, F.lit(100)), F.lit("-"), F.left(F.sha2(given, 256), F.lit(16))))
    facts = F.to_json(F.struct(*[c for c in outputs.columns if c not in ("text", "markdown")]))
    one = lambda file, content: F.struct(F.lit(file).alias("name"), content.cast("binary").alias("content"))
    files = F.array(one("status.json", facts), F.when(F.col("markdown").isNotNull(), one("translated.md", F.col("markdown"))))
    return outputs.where(given.isNotNull()).select(name.alias("job_id"), F.explode(F.array_compact(files)).alias("f")).select("job_id", "f.name", "f.content")
