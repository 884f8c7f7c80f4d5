"""python -m lexweave translate FOLDER OUTPUT [--target en] [--thorough] [--no-translate] [--mock] [--memo URI] [--config FILE] | evaluate FOLDER | list-llms | check"""

from __future__ import annotations

import argparse
import os
import re
import sys
import tempfile
import uuid
import zlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexweave import config, preflight
from lexweave.functions.formats import OWN_FORMAT, PRICES, export_format
from lexweave.operators.completion import asking, mock
from lexweave.operators.jobs import batch_status, results_report
from lexweave.operators.providers import catalogue, factory
from lexweave.plans import evaluation, service
from lexweave.sinks import folders
from lexweave.sinks.exports import exported, write_files
from lexweave.sinks.memo import memo
from lexweave.sinks.outputs import metadata, write_texts
from lexweave.sources.files import extract
from lexweave.sources.pages import pymupdf
from lexweave.sources.programs import legacy_word, readers


def _pdf_text(content: bytes) -> tuple[str, str]:
    return "\n".join(text for text, _ in pymupdf(content, 150)), "pymupdf"


def translate(spark: SparkSession, a: argparse.Namespace, complete=None) -> int:
    """Exit code of the batch: 0, 3 for warnings, 2 for failures.  Without a client the settings' provider is asked, or with --mock a mock."""
    settings = config.load(a.config)
    if complete is None:
        complete = asking(factory(settings.llm, seconds=settings.llm_timeout, counts=True), settings.workers, settings.max_retries, settings.retry_base_delay, tasks=2 * spark.sparkContext.defaultParallelism) if not a.mock else mock()
    found = extract(spark, a.folder, readers(spark, a.folder, {"doc": legacy_word(settings.subprocess_timeout), "pdf": _pdf_text}))
    documents = found.select(F.col("path").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    glossary = None if settings.glossary is None else spark.read.text(settings.glossary, wholetext=True).first()[0]
    options = service.Options(target=a.target or settings.target_lang, llm=settings.llm, thorough=a.thorough, no_translate=a.no_translate, glossary=glossary, fail_on_empty=settings.fail_on_empty_extraction)
    run = a.run or uuid.uuid4().hex
    known = None if a.memo is None else memo(spark, f"lexweave_memo_{zlib.crc32(a.memo.encode()):08x}", a.memo)
    got = service.run(documents, complete, options, memo=None if known is None else known.rows(spark))
    if known is not None:
        known.append(got.memo, run)
        known.compact(spark, least=32)
    outputs = got.outputs.checkpoint()
    folder = a.folder.split("://")[-1] if "://" in a.folder else os.path.abspath(a.folder)
    relative = F.regexp_replace("doc_id", "^.*?" + re.escape(folder.rstrip("/")) + "/", "")  # names of two folders' files may be the same
    named = outputs.withColumn("name", relative)
    write_texts(named, f"{a.output}/texts", key="name")
    metadata(named, "name").write.mode("overwrite").parquet(f"{a.output}/metadata")
    got.usage.write.mode("overwrite").parquet(f"{a.output}/usage")
    got.issues.write.mode("overwrite").parquet(f"{a.output}/issues")
    jobs = outputs.withColumns({"job_id": F.col("doc_id").cast("string"), "target_lang": F.lit(options.target), "no_translate": F.lit(options.no_translate), "model": F.lit(options.llm), "source_file": F.regexp_replace("doc_id", "^.*/", "")})
    differences = None if got.discrepancies is None else got.discrepancies.withColumn("job_id", F.col("doc_id").cast("string"))
    results_report(jobs, got.issues, differences).write.mode("overwrite").parquet(f"{a.output}/reports")
    if a.folders:
        folders.register(spark)
        folders.files_of(outputs, relative).write.format("job_folders").mode("append").option("path", a.folders).option("run", run).save()
    if a.export:
        wanted = settings.export_format if a.export == "own" else a.export
        fmt = export_format(F.col("doc_id"), None if wanted is None else F.lit(wanted))
        files = named.where("status <> 'failed'").select("name", "markdown", fmt.alias("format"), F.lit(options.target).alias("lang"))
        write_files(exported(files), f"{a.output}/files").write.mode("overwrite").parquet(f"{a.output}/exports")
    row = batch_status(outputs).first()
    print(row.asDict())
    return row["exit_code"]


def evaluate(spark: SparkSession, a: argparse.Namespace, providers: dict[str, evaluation.Provider] | None = None) -> int:
    """Reads a folder's files with every backend and prints a line each, or a pass rate against golden texts; 1 where there are none."""
    native = {"native": lambda content: (lambda pages: ("\n".join(pages), len(pages), "pymupdf"))([t for t, _ in pymupdf(content, 150)])}
    rows = evaluation.measured(spark, a.folder, providers or native).checkpoint()
    if rows.isEmpty():
        print(f"no files in {a.folder}", file=sys.stderr)
        return 1
    if a.golden or a.report:
        cases = evaluation.golden(spark, a.golden) if a.golden else evaluation.golden_of(rows).limit(0)
        scores = evaluation.scored(rows, cases).checkpoint()
        total = evaluation.qa_summary(scores).first()
        print(f"pass rate: {total['pass_rate']}% ({total['passed']} of {total['total']})")
        if a.report:
            with open(a.report, "w", encoding="utf-8") as f:
                f.writelines(evaluation.html_report(scores))
    if a.json or not (a.golden or a.report):
        for line in evaluation.lines(rows.orderBy("file", "backend"), a.json).toLocalIterator():
            print(line["line"])
    return 0


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("translate")
    one.add_argument("folder")
    one.add_argument("output")
    one.add_argument("--target")
    one.add_argument("--config")
    one.add_argument("--checkpoints", default=None)
    one.add_argument("--thorough", action="store_true")
    one.add_argument("--no-translate", action="store_true")
    one.add_argument("--mock", action="store_true", help="a mock answers in place of the settings' provider, as in a rehearsal")
    one.add_argument("--export", choices=["own", *OWN_FORMAT], help="also write files: in the setting's or the input's own format, or in one for all")
    one.add_argument("--folders", help="also write a folder for each job to this URI, as one transaction")
    one.add_argument("--run", help="the name of the folders' transaction and of the memo's batch: one of the same name is replaced")
    one.add_argument("--memo", help="a shared folder that keeps translated chunks: what it has is not asked again")
    two = commands.add_parser("evaluate")
    two.add_argument("folder")
    two.add_argument("--golden")
    two.add_argument("--report")
    two.add_argument("--json", action="store_true")
    two.add_argument("--checkpoints", default=None, help="a folder that all machines share; needed where spark.checkpoint.dir is unset, but on one machine")
    commands.add_parser("list-llms")
    three = commands.add_parser("check")
    three.add_argument("--config")
    three.add_argument("--format", choices=OWN_FORMAT)
    three.add_argument("--require-ocr", action="store_true")
    three.add_argument("--ocr-url")
    a = parser.parse_args(arguments)
    if a.command == "list-llms":
        for name, here in catalogue():
            into, out = PRICES[name]
            print(f"{name}\t{into:g}\t{out:g}\t{'built in' if here else 'own client'}")
        return 0
    if a.command == "check":
        found = preflight.checks(config.load(a.config), fmt=a.format, ocr=a.require_ocr, ocr_url=a.ocr_url)
        print("\n".join(f"{c.name}\t{c.status}\t{c.message}" for c in found))
        return 0 if preflight.ready(found) else 1
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if not spark.sparkContext.getCheckpointDir():
        where = a.checkpoints or (f"{a.output}/.checkpoints" if a.command == "translate" else None)
        if where is None and not spark.sparkContext.master.startswith("local"):
            parser.error("set spark.checkpoint.dir or --checkpoints to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="lexweave-"))
    return evaluate(spark, a) if a.command == "evaluate" else translate(spark, a)


if __name__ == "__main__":
    sys.exit(main())
