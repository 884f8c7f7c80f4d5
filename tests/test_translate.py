"""Glossaries, detection, translation with a memo, rules, whole jobs and streams."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from lexweave.functions import formats as R
from lexweave.functions import rules as U
from lexweave.functions import text as T
from lexweave.operators import detect as D
from lexweave.operators import glossary as G
from lexweave.operators import jobs as J
from lexweave.operators import translate as TR
from lexweave.operators.completion import mock
from lexweave.plans import service as S
from lexweave.sources.tables import html_text, text_files
from lexweave.streaming import status as W


def value(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_glossary(spark):
    payload = json.dumps({"Acme": "ACME", " Müller ": "", "cat": "gato", "dog": {"preferred": "perro"}, "own": {"do_not_translate": True, "preferred": "x"}, "bare": {}, "": "no", "silent": {"preferred": ""}, "n": 7})
    got = value(spark, G.parse(F.col("t")), t=payload)
    assert got["preferred"] == {"cat": "gato", "dog": "perro", "n": "7"} and got["keep"] == ["Acme", "Müller", "bare", "own"]
    assert value(spark, G.parse(F.col("t")), t="[1]") is None and value(spark, G.parse(F.col("t")), t="no json") is None
    both = G.merge(G.parse(F.col("a")), G.parse(F.col("b")))
    a, b = json.dumps({"x": "1", "y": "2", "z": "z"}), json.dumps({"y": "3", "x": "X"})
    assert value(spark, both, a=a, b=b).asDict(True) == {"preferred": {"x": "1", "y": "3"}, "keep": ["x", "z"]}
    assert value(spark, G.prompt_block(both), a=a, b=b) == "Glossary terms:\n- 'x': keep unchanged (do not translate)\n- 'z': keep unchanged (do not translate)\n- 'y' → '3'"
    assert value(spark, G.prompt_block(G.parse(F.col("t"))), t=json.dumps({"it's": 'a "b"'})) == "Glossary terms:\n- \"it's\" → 'a \"b\"'"
    assert value(spark, G.tokens(both), a=a, b=b) == ["1", "3", "x", "z"] and value(spark, G.prompt_block(G.parse(F.col("t"))), t="{}") == ""


@pytest.mark.parametrize("text,lang", [("The cat and the dog are in the house with a lot of food for the winter.", "en"), ("Der Hund und die Katze sind nicht in dem Haus, das wir mit der Familie haben.", "de"), ("Этот документ написан на русском языке, и его надо перевести.", "ru"), ("El perro y la casa que los niños en el pueblo tienen para las fiestas del año.", "es")])
def test_language(spark, text, lang):
    got = value(spark, D.language(F.col("t")), t=text)
    assert got["lang"] == lang and got["confidence"] > 0.5 and not got["used_ai"]


def test_language_without_signs(spark):
    assert tuple(value(spark, D.language(F.col("t")), t="short")) == ("unknown", 0.0, False)
    assert tuple(value(spark, D.language(F.col("t"), mock()), t="short")) == ("es", 0.5, True)
    odd = "qqqq wwww " * 10
    assert tuple(value(spark, D.language(F.col("t")), t=odd)) == ("unknown", 0.0, False)
    mixed = "the and of der die das und le les et est el los " * 3
    got = value(spark, D.language(F.col("t"), mock()), t=mixed)
    assert got["lang"] == "es" and got["used_ai"] and got["confidence"] < D.CONFIDENT
    assert value(spark, D.source_mismatch(F.col("a"), F.col("b")), a="en", b="de") and not value(spark, D.source_mismatch(F.col("a"), F.col("b")), a="en", b="unknown")


def test_legal(spark):
    one, two, three = "The party came.", "The party shall pay.", "The party shall pay under this contract."
    assert [value(spark, D.legal(F.col("t"))["is_legal"], t=t) for t in ("nothing", one, two, three)] == [False, False, True, True]
    said = lambda answer, t=one: tuple(value(spark, D.legal(F.col("t"), lambda s, u: F.lit(answer)), t=t))
    assert said('so: {"is_legal": true}') == (True, True, False) and said('{"is_legal": false}', two) == (False, True, False)
    assert said("no json") == (False, True, True) and said("{broken}", two) == (True, True, True) and said("{}", three) == (True, False, False)


def test_prompts(spark):
    block = TR.context_block(F.lit(" about cats "), G.parse(F.lit('{"cat": "gato"}')), F.lit("sum"), F.lit("# H"))
    assert value(spark, block, t="") == "Translation context:\nabout cats\nGlossary terms:\n- 'cat' → 'gato'\nDocument summary:\nsum\nSection context: # H\n\n"
    assert value(spark, TR.context_block(F.lit(""), None, F.lit(" "), F.lit("")), t="") == ""
    got = value(spark, TR.user_prompt(F.lit(0), F.lit("text"), F.lit("de"), F.lit("en"), F.lit(True), F.lit("")), t="")
    assert got.startswith("Source language: de. Target language: English (en). This is a legal") and got.endswith("\nChunk 1\n\ntext")


def test_chunks_meet_the_memo(spark):
    docs = spark.createDataFrame([(1, "# A\n\nOne.\n\n# B\n\nTwo."), (2, "Three."), (3, "")], "doc_id long, text string")
    docs = docs.selectExpr("*", "'de' AS source_lang", "'en' AS target_lang", "false AS is_legal", "'' AS context")
    chunks = TR.document_chunks(docs, "doc_id", "m")
    memo = chunks.where("doc_id = 1 AND chunk_index = 0").selectExpr("doc_id", "chunk_index", "pass_num", "llm", "source_hash", "'kept' AS text")
    memo = memo.unionByName(memo).unionByName(chunks.where("doc_id = 2").selectExpr("doc_id", "chunk_index", "pass_num", "'other' AS llm", "source_hash", "'not this' AS text"))
    assert {(r["doc_id"], r["chunk_index"]) for r in TR.pending(chunks, memo, ["doc_id"]).collect()} == {(1, 1), (2, 0)}
    got = {(r["doc_id"], r["chunk_index"]): r["text"] for r in TR.translate_chunks(chunks, mock("X "), memo, ["doc_id"]).collect()}
    assert got[1, 0] == "kept" and got[1, 1].endswith("# B\n\nTwo.") and got[2, 0].startswith("X Source language: de") and len(got) == 3
    assert "Section context: # B" in got[1, 1]


def test_rules(spark):
    ok = lambda t: value(spark, U.job_id_ok(F.col("t")), t=t)
    assert ok("a-B_9") and ok("x" * 128) and not ok("x" * 129) and not ok("a/b") and not ok("") and not ok(None)
    error = lambda t, **k: value(spark, U.webhook_error(F.col("t"), **k), t=t)
    assert error("https://example.com/x") is None and error("http://e.com", https_only=True) == "scheme" and error("file:///x") == "scheme" and error("http:///x") == "host"
    for host in ("127.0.0.1", "10.1.2.3", "172.16.0.1", "172.31.255.255", "192.168.0.9", "169.254.1.1", "[::1]", "[fc00::1]", "[fe80::1]", "user:pw@10.0.0.1"):
        assert error(f"http://{host}:80/x") == "address", host
    for host in ("8.8.8.8", "172.32.0.1", "11.0.0.1", "[2001:db8::1]", "10.example.com"):
        assert error(f"http://{host}/x") is None, host
    assert error("http://LOCALHOST/x") == "localhost" and error("http://e.com", resolved=F.array(F.lit("10.0.0.1"))) == "address"
    want = "sha256=" + hmac.new(b"key", "bödy".encode(), hashlib.sha256).hexdigest()
    assert value(spark, U.signature(F.col("a"), F.col("b")), a="bödy", b="key") == want
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    after = lambda t: value(spark, U.retry_after(F.col("t"), now), t=t)
    assert [after(" 2.5 "), after("-3"), after("Mon, 01 Jan 2024 00:01:00 GMT"), after("Sun, 31 Dec 2023 00:00:00 GMT"), after("soon"), after(None)] == [2.5, 0.0, 60.0, 0.0, None, None]
    assert value(spark, U.retry_delay(F.lit(3), F.lit(None).cast("double")), t="") == 8.0 and value(spark, U.retry_delay(F.lit(9), F.lit(500.0)), t="") == 120.0
    assert value(spark, U.selector_ok(F.col("t")), t="anything") and value(spark, U.selector_ok(F.col("t")), t="openai:gpt-4o") and not value(spark, U.selector_ok(F.col("t")), t="openai:none")
    assert value(spark, U.report_severities(F.col("t")), t=" Warning,error,warn,odd") == ["warn", "error"] and value(spark, U.report_severities(F.col("t")), t="") == ["error"]
    assert value(spark, U.checkpoint_name(F.lit(2), F.lit(7)), t="") == "translate-pass2-chunk-0007.md" and value(spark, U.source_chunk_name(F.lit(3)), t="") == "chunk-0003.md"
    assert value(spark, U.backend(F.col("a"), F.col("b")), a="x.pptx", b="auto") == "layout" and value(spark, U.backend(F.col("a"), F.col("b")), a="x.png", b="native") is None and value(spark, U.backend(F.col("a"), F.col("b")), a="x.pdf", b="auto") == "native"
    same = {n: F.lit("a") for n in ("llm", "mode", "target_lang", "source_hash")}
    assert value(spark, U.resume_error(same, same), t="") is None and value(spark, U.resume_error(same, same | {"mode": F.lit("b"), "source_hash": F.lit("b")}), t="") == "mode"
    assert value(spark, U.merged_lines(F.array(F.lit(" a "), F.lit(""), F.lit("b"))), t="") == "a\nb" and value(spark, U.body_text(F.lit("t"), F.lit(" "), F.lit(True)), t="") == "t"
    assert value(spark, U.extracted_markdown(F.struct(F.lit(1).alias("a")), F.lit("body \n\n")), t="") == '---\n{"a":1}\n---\n\nbody\n'


def test_formats_and_sources(spark, tmp_path):
    assert R.rtf_plain(r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}A\'e9\par B \u8364?C\{\}{\b bold}}") == "Aé\nB \u20acC{}bold"
    html = "<head><title>no</title></head><h2>T</h2><p>a &amp;lt; <b>b</b> <a class=x href=\"u\">l</a></p><nav>kept</nav><!-- gone --><script>x</script>"
    assert value(spark, html_text(F.col("t")), t=html) == "## T\n\na &lt; **b** [l](u)\n\nkept"
    assert value(spark, T.redact_secrets(F.col("t")), t="Bearer\tabc Bearer  d") == "<redacted> <redacted>"
    (tmp_path / "a.TXT").write_bytes(b"one\r\ntwo\xff ")
    (tmp_path / "b.markdown").write_text("# x")
    (tmp_path / "c.pdf").write_text("no")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in text_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.TXT", "b.markdown"} and rows["a.TXT"]["text"] == "one\ntwo�\n" and rows["a.TXT"]["encoding_loss"] and rows["b.markdown"]["text"] == "# x\n"


def test_jobs(spark, tmp_path):
    names = iter(range(1000))

    def save(df, name):
        at = f"{tmp_path}/{name}{next(names)}"
        df.write.parquet(at)
        return spark.read.parquet(at)

    german = "Der Vertrag und die Haftung sind nicht mit der Partei, das ist für uns. Wir zahlen 100 Euro. "
    docs = spark.createDataFrame([(1, german, None), (2, "The cat and the dog are in the house with a lot of food.", None), (3, " ", None), (4, german, "fr")], "doc_id long, text string, source_lang string")
    got = S.run(docs, mock(), S.Options(date="2024-01-01 00:00 UTC"), save=save)
    rows = {r["doc_id"]: r for r in got.outputs.collect()}
    assert {k: (r["status"], r["skipped"]) for k, r in rows.items()} == {1: ("completed", False), 2: ("completed", True), 3: ("failed", False), 4: ("completed_with_warnings", False)}
    assert rows[1]["text"].startswith("[EN] Source language: de") and rows[2]["text"].startswith("The cat") and "**Outcome:**" in rows[1]["markdown"]
    assert {(r["job_id"], r["code"]) for r in got.issues.collect()} >= {("4", "SOURCE_LANG_MISMATCH"), ("3", "EMPTY_EXTRACTION")}
    again = S.run(docs, mock("other "), S.Options(), memo=got.memo, save=save)
    assert {r["doc_id"]: r["text"] for r in again.outputs.collect()}[1] == rows[1]["text"]
    assert {r["doc_id"]: (r["done"], r["chunks"]) for r in S.resume(docs.where("doc_id < 3"), got.memo, S.Options()).collect()} == {1: (1, 1), 2: (0, 1)}
    thorough = S.run(docs, mock(), S.Options(thorough=True, glossary='{"Euro": "euro"}'), save=save)
    assert {r["doc_id"]: r["status"] for r in thorough.outputs.collect()}[1] == "completed" and thorough.discrepancies.count() == 0
    untouched = S.run(docs, mock(), S.Options(no_translate=True, include_cover=False), save=save)
    assert all(r["skipped"] for r in untouched.outputs.collect())


def test_reports(spark):
    jobs = spark.createDataFrame([("a", "completed", False, False, "de", "en"), ("b", "failed", False, False, "de", "en")], "job_id string, status string, no_translate boolean, skipped boolean, source_lang string, target_lang string")
    issues = spark.createDataFrame([("a", "X", "warn", "m|1", "s", 1), ("a", "Y", "error", "m2", "s", 0)], "job_id string, code string, severity string, message string, stage string, pos long")
    found = spark.createDataFrame([("a", 1, "breaking", False, "why")], "job_id string, pos int, severity string, resolved boolean, explanation string")
    summary = {r["job_id"]: r for r in J.job_summary(jobs, issues, found).collect()}
    assert summary["a"]["warnings"] == ["m2", "m|1"] and summary["a"]["items"] == ["why"] and summary["b"]["items"] == []
    report = {r["job_id"]: r["markdown"] for r in J.results_report(jobs, issues).collect()}
    assert report["a"].index("| Y | error | s | m2 |") < report["a"].index("| X | warn | s | m/1 |") and "## Issues\n\n_(none)_" in report["b"]
    rows = spark.createDataFrame([("a", 2, 5, "breaking", False, "a|b"), ("a", 1, 0, "low", True, None)], "job_id string, chunk_index int, sentence_index int, severity string, resolved boolean, explanation string")
    more = jobs.withColumns({"alerts": F.array(F.lit("EMPTY")), "error": F.when(F.col("status") == "failed", "broke"), "stage": F.lit("exporting"), "seconds": F.lit(1.25), "is_legal": F.lit(True), "confidence": F.lit(0.5)})
    full = {r["job_id"]: r["markdown"] for r in J.results_report(more, issues, rows, F.create_map(F.lit("z"), F.lit(False), F.lit("b"), F.lit(True))).collect()}
    assert "| 1 | 0 | low | yes |  |\n| 2 | 5 | breaking | no | a/b |" in full["a"] and "- **Breaking** (chunk 2, sentence 5): a|b" in full["a"] and "- b: yes\n- z: no" in full["a"]
    assert "Stage `exporting`: broke" in full["b"] and "## Failure" not in full["a"] and "- Confidence: 0.5" in full["a"] and "- **EMPTY**" in full["a"] and "The passes do not differ." in full["b"]


def test_streams(spark, tmp_path):
    rows = [("a", "extracting", "running", 0.05, "2024-01-01 00:00:00"), ("a", "done", "completed", 1.0, "2024-01-01 00:00:05"), ("a", "done", "completed", 1.0, "2024-01-01 00:00:05"), ("b", "queued", "running", 0.0, "2024-01-01 00:00:01")]
    events = spark.createDataFrame(rows, "job_id string, stage string, status string, progress double, updated_at string").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(W.EVENTS).parquet(f"{tmp_path}/events")
    query = W.latest(stream).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["job_id"]: r["status"] for r in spark.table("latest").collect()} == {"a": "completed", "b": "running"} == {r["job_id"]: r["status"] for r in W.latest(events).collect()}
    seen = []
    W.each_terminal(stream, lambda df, n: seen.extend(r["job_id"] for r in df.collect()), f"{tmp_path}/c1").awaitTermination()
    assert seen == ["a"] and W.terminal(events).count() == 1
    for _ in range(2):
        W.append_memo(stream.select("job_id"), f"{tmp_path}/memo", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/memo").count() == 4
