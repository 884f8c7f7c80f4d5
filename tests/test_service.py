"""Files to outputs: the dispatcher, the command line, settings and notices."""

import json
import zipfile

import pytest

from lexweave import __main__ as cli
from lexweave import config, preflight
from lexweave.sinks import outputs as O
from lexweave.sources.files import extract, inputs


def folder(at):
    (at / "a.TXT").write_text("The cat and the dog are in the house with the food for it.")
    (at / "b.md").write_text("---\nx: 1\n---\n\n# Titel\n\nDer Hund und die Katze sind nicht in dem Haus, das wir mit der Familie haben.")
    (at / "c.html").write_text("<h1>One</h1><p>two</p>")
    (at / "d.rtf").write_text(r"{\rtf1 Hello\par there}")
    (at / "e.pdf").write_text("%PDF")
    (at / "f.png").write_bytes(b"x")
    (at / "g.exe").write_bytes(b"x")
    with zipfile.ZipFile(at / "h.docx", "w") as z:
        z.writestr("word/other.xml", "")
    return str(at)


def test_dispatch(spark, tmp_path):
    at = folder(tmp_path)
    listed = {r["path"].rsplit("/", 1)[1]: r for r in inputs(spark, at).collect()}
    assert listed["g.exe"]["error"] == "unsupported" and listed["a.TXT"]["error"] is None and listed["b.md"]["format"] == "md" and listed["e.pdf"]["bytes"] == 4
    assert {r["error"] for r in inputs(spark, at, most=3).where("suffix = 'pdf'").collect()} == {"too large"}
    rows = {r["path"].rsplit("/", 1)[1]: r for r in extract(spark, at).collect()}
    assert rows["b.md"]["text"].startswith("# Titel") and rows["c.html"]["text"] == "# One\n\ntwo\n" and rows["d.rtf"]["text"] == "Hello\nthere\n"
    assert rows["e.pdf"]["error"] == "needs a reader" and rows["f.png"]["error"] == "needs a recogniser" and "KeyError" in rows["h.docx"]["error"] and len(rows) == 8
    pdf = lambda df: df.selectExpr("path", "'page' AS text", "CAST(NULL AS STRING) AS error")
    assert {r["text"] for r in extract(spark, at, {"pdf": pdf}).where("path LIKE '%.pdf'").collect()} == {"page\n"}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("The cat and the dog are in the house with the food for it.")
    (tmp_path / "in" / "b.txt").write_text("Der Hund und die Katze sind nicht zu Hause, das ist für uns und die Familie nicht von Belang.")
    assert cli.main(["translate", str(tmp_path / "in"), str(tmp_path / "out"), "--mock", "--folders", f"file://{tmp_path}/jobs", "--run", "r", "--memo", f"file://{tmp_path}/memo"]) == 0
    assert spark.read.parquet(f"{tmp_path}/memo/buckets-256").where("batch = 'r'").count() == 1
    files = {(r["job_id"].split("-")[0], r["name"]) for r in spark.read.format("job_folders").option("path", f"file://{tmp_path}/jobs").load().collect()}
    assert files == {(j, n) for j in ("a_txt", "b_txt") for n in ("status.json", "translated.md")}
    assert spark.read.parquet(f"{tmp_path}/out/usage").count() == 2
    texts = {p.parent.name: p.read_text() for p in (tmp_path / "out" / "texts").rglob("part-*")}
    assert set(texts) == {"name=a.txt", "name=b.txt"} and "[EN] Source language: de" in texts["name=b.txt"]
    assert json.loads(spark.read.parquet(f"{tmp_path}/out/metadata").where("name = 'a.txt'").first()["metadata"])["skipped"] is True
    with pytest.raises(ValueError, match="CONFIGURATION_ERROR"):  # no client of the default provider is here
        cli.main(["translate", str(tmp_path / "in"), str(tmp_path / "out")])
    assert cli.main(["list-llms"]) == 0 and "openai:gpt-4o" in capsys.readouterr().out
    assert spark.read.parquet(f"{tmp_path}/out/reports").where("markdown LIKE '# Results%## For review%'").count() == spark.read.parquet(f"{tmp_path}/out/metadata").count()
    (tmp_path / "in2").mkdir()
    (tmp_path / "in2" / "x.txt").write_text("some text")
    a = cli.argparse.Namespace(folder=str(tmp_path / "in2"), golden=None, report=str(tmp_path / "r.html"), json=False)
    assert cli.evaluate(spark, a, {"plain": lambda c: (c.decode(), None, "plain")}) == 0 and "pass rate: 100.0% (1 of 1)" in capsys.readouterr().out
    assert "x.txt" in (tmp_path / "r.html").read_text()


def test_checks(tmp_path):
    settings = config.load(None, {"LEXWEAVE_LLM": "openai:gpt-4o"})
    found = {c.name: c for c in preflight.checks(settings, str(tmp_path), "md", layout=False, environment={"OPENAI_API_KEY": "k"})}
    assert found["llm_key"].ok and found["llm_client"].ok and "pandoc" not in found and preflight.ready(list(found.values()))
    found = {c.name: c for c in preflight.checks(settings, str(tmp_path), "doc", ocr=True, ocr_url="http://127.0.0.1:1/", environment={})}
    assert found["llm_key"].status == "fail" and found["ocr_server"].status == "warn" and found["libreoffice"].required and not preflight.ready(list(found.values()))
    assert preflight.blank_image().startswith(b"\x89PNG")


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"chunk_size": 100, "odd": 1, "target_lang": " DE "}))
    got = config.load(str(tmp_path / "c.json"), {"LEXWEAVE_CHUNK_SIZE": "200", "LEXWEAVE_LLM": "gpt", "LEXWEAVE_WORKERS": "", "LEXWEAVE_WEBHOOK_HTTPS_ONLY": "yes"})
    assert (got.chunk_size, got.llm, got.workers, got.target_lang, got.unknown, got.webhook_https_only) == (200, "cursor:gpt", 4, "de", ("odd",), True)
    assert str(got.runs_path("/r")) == "/r/runs"
    for bad in ({"CHUNK_SIZE": "0"}, {"MAX_RETRIES": "-1"}, {"LLM": "openai:none"}, {"TARGET_LANG": "deu"}, {"WEBHOOK_URL": "ftp://x"}, {"SIMILARITY_THRESHOLD": "101"}, {"EXPORT_FORMAT": "xyz"}):
        with pytest.raises(ValueError):
            config.load(None, {f"LEXWEAVE_{k}": v for k, v in bad.items()})


def test_notices(spark):
    jobs = spark.createDataFrame([("a", "completed"), ("b", "failed")], "job_id string, status string")
    rows = O.notices(jobs, "https://example.com/hook", "key")
    assert json.loads(rows.where("job_id = 'a'").first()["body"]) == {"event": "job.terminal", "job": {"job_id": "a", "status": "completed"}}
    tried = []

    def send(url, body, headers):
        tried.append(url)
        if '"a"' in body.decode() or len(tried) < 2:
            raise ConnectionError("down")
        assert headers["X-Signature"].startswith("sha256=")

    got = {r["job_id"]: r for r in O.deliver(rows.coalesce(1), send, retries=2, base=0.0).collect()}
    assert not got["a"]["delivered"] and got["a"]["error"] == "WEBHOOK_FAILED: down" and got["b"]["delivered"]
    refused = O.deliver(O.notices(jobs, "http://10.0.0.1/"), send).collect()
    assert all(r["error"] == "address" and not r["delivered"] for r in refused)


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for sub in ("a", "b"):
        (tmp_path / "in" / sub).mkdir(parents=True)
        (tmp_path / "in" / sub / "x.txt").write_text(f"The text of folder {sub} and the food for it.")
    assert cli.main(["translate", str(tmp_path / "in"), str(tmp_path / "out"), "--mock", "--no-translate", "--export", "md"]) == 0
    assert {str(p.relative_to(tmp_path / "out" / "files")) for p in (tmp_path / "out" / "files").rglob("*.md")} == {"a/x.txt.md", "b/x.txt.md"}
    for sub in ("a", "b"):
        assert f"folder {sub}" in (tmp_path / "out" / "files" / sub / "x.txt.md").read_text()
    assert {r["name"] for r in spark.read.parquet(f"{tmp_path}/out/metadata").collect()} == {"a/x.txt", "b/x.txt"}
    assert len({p.parent for p in (tmp_path / "out" / "texts").rglob("part-*")}) == 2
