import io
import json
import logging

import pytest

from lexweave import observability as O
from lexweave.control import Cancelled, Job, TimedOut
from lexweave.operators import providers as V
from lexweave.plans import evaluation as E


def reads(content):
    if content == b"bad":
        raise ValueError("<broken>")
    return content.decode(), 1, "plain"


def test_evaluation(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in {"a.txt": b"hello\r\n", "b.txt": b"bad", "c.png": b"image"}.items():
        (tmp_path / "in" / name).write_bytes(content)
    rows = E.measured(spark, str(tmp_path / "in"), {"native": reads, "layout": lambda c: ("", 0, "none")}).cache()
    got = {(r["file"], r["backend"]): r for r in rows.collect()}
    assert len(got) == 6 and got["c.png", "native"]["error"] == "native does not support .png files" and got["b.txt", "native"]["error"] == "<broken>"
    assert got["a.txt", "native"]["chars"] == 7 and got["a.txt", "native"]["hash"] == E._hash("hello")
    E.write_golden(E.golden_of(rows.where("backend = 'native'"), 3), str(tmp_path / "golden"))
    written = json.loads(spark.read.text(str(tmp_path / "golden"), wholetext=True).first()[0])
    assert written["version"] == 1 and [c["file"] for c in written["cases"]] == ["a.txt"]
    cases = E.golden(spark, str(tmp_path / "golden"))
    done = E.scored(rows, cases)
    state = {(r["file"], r["backend"]): r for r in done.collect()}
    assert state["a.txt", "native"]["passed"] and state["b.txt", "native"]["failures"] == ["extract: <broken>"]
    assert state["a.txt", "layout"]["failures"] == ["min_chars: 0 chars (min 1)", "pages: 0 pages"]
    page = "".join(E.html_report(done))
    assert "&lt;broken&gt;" in page and "<broken>" not in page and "16.7% (1 of 6)" in page
    text = [r["line"] for r in E.lines(rows.where("file = 'a.txt' AND backend = 'native' OR file = 'b.txt' AND backend = 'native'")).collect()]
    assert any(t.startswith("a.txt\tnative\t7 chars\t1 pages\t") for t in text) and "b.txt\tnative\tERROR\t<broken>" in text
    assert json.loads(E.lines(rows.where("backend = 'native' AND file = 'b.txt'"), True).first()[0])["chars"] is None


def test_providers():
    seen = []

    def send(url, headers, body, seconds):
        seen.append((url, headers, body))
        return answers[len(seen) - 1]

    answers = [
        {"choices": [{"message": {"content": " one "}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}},
        {"content": [{"type": "text", "text": "two"}]},
        {"candidates": [{"content": {"parts": [{"text": "th"}, {"text": "ree"}]}}], "usageMetadata": {"promptTokenCount": 5}},
        {"choices": [{"message": {"content": None}}]},
    ]
    used = []
    assert V.factory("openai:gpt-4o", "k", send=send, used=lambda i, o: used.append((i, o)))()("s", "u") == "one"
    assert V.factory("anthropic:x", "k", send=send)()("s", "u") == "two" and V.factory("google:g", "k", send=send)()("s", "u") == "three"
    assert used == [(3, 2)] and seen[2][0].endswith("/g:generateContent") and seen[1][2]["max_tokens"] == 8192
    with pytest.raises(RuntimeError, match="empty answer"):
        V.factory("openai:gpt-4o", "k", send=send)()("s", "u")
    with pytest.raises(ValueError, match="CONFIGURATION_ERROR"):
        V.factory("model")
    assert V.wait_of("3") == 3 and V.wait_of("-1") == 0 and V.wait_of("soon") is None and V.wait_of(None) is None
    assert V.wait_of("Wed, 21 Oct 2015 07:28:00 GMT") == 0 and dict(V.catalogue())["openai:gpt-4o"]


def test_providers_without_a_key(monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(ValueError, match="OPENAI_API_KEY is not set"):
        V.factory("openai:gpt-4o")()


def test_logs_and_listeners(spark, tmp_path):
    stream = io.StringIO()
    log = O.configure("odd", as_json=True, stream=stream)
    assert log.level == logging.INFO
    log.warning("text %s", 1, extra={"job_id": "j", "stage": None})
    row = json.loads(stream.getvalue())
    assert row["message"] == "text 1" and row["job_id"] == "j" and "stage" not in row and row["level"] == "WARNING"
    issues = spark.createDataFrame([("j1", "A", "warn", "m", "extracting"), ("j2", "B", "error", "n", None)], "job_id string, code string, severity string, message string, stage string")

    def fails():
        def tell(issue):
            raise RuntimeError("listener")

        return tell

    folder = str(tmp_path)

    def notes():
        return lambda issue: open(f"{folder}/{issue['job_id']}", "w").write(issue["code"])

    O.announce(issues, [fails, O.logging_listener, notes, O.tracker_listener("https://k@example.com/1")])
    assert (tmp_path / "j1").read_text() == "A" and (tmp_path / "j2").read_text() == "B"


def test_deadlines(spark):
    slow = lambda: spark.range(0, 4, 1, 4).selectExpr("java_method('java.lang.Thread', 'sleep', 20000L)").write.format("noop").mode("overwrite").save()
    with pytest.raises(TimedOut):
        with Job(spark, seconds=1.0) as job:
            job.check("extracting")
            slow()
    assert job.elapsed() < 15
    with pytest.raises(Cancelled):
        with Job(spark) as job:
            job.cancel()
            job.check("translating")
    with pytest.raises(ZeroDivisionError):
        with Job(spark, seconds=60):
            1 / 0
    assert not spark.sparkContext.getJobTags()
