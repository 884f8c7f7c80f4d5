"""Calls that fail are their document's failure alone; calls at the same time, in order; usage of jobs."""

import itertools
import threading
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from lexweave.operators import completion as C
from lexweave.operators import translate as TR
from lexweave.plans import service as S

NAMES = itertools.count()
GERMAN = "Der Vertrag und die Haftung sind nicht mit der Partei, das ist für uns. "


def saver(spark, tmp_path):
    names = NAMES

    def save(df, name):
        at = f"{tmp_path}/{name}{next(names)}"
        df.write.parquet(at)
        return spark.read.parquet(at)

    return save


def documents(spark, n):
    rows = [(i, "\n\n".join(f"# H{k}\n\n{GERMAN}Teil {i}.{k}." for k in range(1 + i % 3))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'de' AS source_lang")


def seventh():
    """A client that fails for chunks whose number of document and chunk, together, sevenths divide."""

    def ask(system, user):
        i, k = map(int, user.rsplit("Teil ", 1)[1].rstrip(".").split("."))
        if (3 * i + k) % 7 == 0:
            raise ValueError(f"refused {i}.{k}")
        return f"T{i}.{k}", 10, 2

    return ask


def test_every_seventh_call_fails(spark, tmp_path):
    docs = documents(spark, 30)
    bad = {i for i in range(30) if any((3 * i + k) % 7 == 0 for k in range(1 + i % 3))}
    for thorough in (False, True):
        got = S.run(docs, C.asking(seventh, workers=3, tasks=2), S.Options(thorough=thorough), save=saver(spark, tmp_path))
        rows = {r["doc_id"]: r for r in got.outputs.collect()}
        assert {i for i, r in rows.items() if r["status"] == "failed"} == bad and len(rows) == 30
        for i, r in rows.items():
            assert (r["text"] is None and r["markdown"] is None) if i in bad else r["text"] == "\n\n".join(f"T{i}.{k}" for k in range(1 + i % 3)) + "\n"
        said = {r["job_id"]: r["message"] for r in got.issues.where("code = 'PIPELINE_FAILED'").collect()}
        first = {str(i): next(k for k in range(3) if (3 * i + k) % 7 == 0) for i in bad}
        assert said == {i: f"Translation failed for chunk {k}: ValueError: refused {i}.{k}" for i, k in first.items()}
        # What succeeded is kept, also of failed documents, and not asked again.
        kept = {(r["doc_id"], r["chunk_index"]) for r in got.memo.where("pass_num = 1").collect()}
        assert kept == {(i, k) for i in range(30) for k in range(1 + i % 3) if (3 * i + k) % 7}
        usage = {r["job_id"]: r for r in got.usage.collect()}
        passes = lambda i: 2 if thorough and i not in bad else 1
        for i in range(30):
            n = passes(i) * sum((3 * i + k) % 7 != 0 for k in range(1 + i % 3))
            assert (usage[str(i)]["n_calls"], usage[str(i)]["tokens_in"], usage[str(i)]["tokens_out"]) == (n, 10 * n, 2 * n)
    calm = S.run(docs, C.counted(lambda s, u: F.lit("late")), S.Options(thorough=True), memo=got.memo, save=saver(spark, tmp_path))
    rows = {r["doc_id"]: r for r in calm.outputs.collect()}
    assert all(r["status"] != "failed" for r in rows.values()) and all(("late" in r["text"]) == (i in bad) for i, r in rows.items())


def test_results_of_documents_in_one_aggregation(spark):
    rows = [(1, 0, "a ", None, 5, 1, False), (1, 1, None, "E", 0, 0, False), (2, 1, "y", None, 4, 2, True), (2, 0, " x", None, 7, 3, False), (3, 0, None, "F", 0, 0, False), (3, 2, None, "G", 0, 0, False)]
    attempts = spark.createDataFrame(rows, "doc_id long, chunk_index int, text string, error string, tokens_in long, tokens_out long, known boolean")
    got = {r["doc_id"]: tuple(r)[1:] for r in TR.document_results(attempts, ["doc_id"]).collect()}
    assert got == {1: ("failed", 2, 1, 1, "E", None, 1, 5, 1), 2: ("completed", 2, 0, None, None, "x\n\ny\n", 1, 11, 5), 3: ("failed", 2, 2, 0, "F", None, 0, 0, 0)}
    assert {r["doc_id"]: tuple(r)[1:] for r in TR.failures(attempts, ["doc_id"]).collect()} == {1: (2, 1, 1, "E"), 3: (2, 2, 0, "F")}


def test_unread_answers_are_issues(spark, tmp_path):
    def odd():
        seen = {}

        def ask(system, user):
            if "equivalent" in system or "best of three" in system:
                return "no json"
            seen[user] = seen.get(user, 0) + 1
            return f"We pay {seen[user]}00 dollars."

        return ask

    docs = spark.createDataFrame([(1, GERMAN, "de")], "doc_id long, text string, source_lang string").coalesce(1)
    prompts = []

    def watching(system, user):
        prompts.append(user)
        return C.asking(odd, workers=1).call(system, user)

    got = S.run(docs, C.Asking(watching), S.Options(thorough=True), memo=None, save=saver(spark, tmp_path))
    assert got.outputs.first()["status"] == "completed"
    # Both passes gave the same text, as each task has its own client, so nothing was compared: now with other texts in the memo.
    other = got.memo.withColumn("text", F.when(F.col("pass_num") == 2, "We pay 999 dollars.").otherwise(F.col("text")))
    got = S.run(docs, C.asking(odd), S.Options(thorough=True), memo=other, save=saver(spark, tmp_path))
    assert got.outputs.first()["status"] == "completed_with_warnings" and got.outputs.first()["text"].strip() == "We pay 100 dollars."
    messages = sorted(r["message"] for r in got.issues.where("code = 'LLM_RESPONSE_PARSE_FAILED'").collect())
    assert messages == ["Answers that were no JSON object (adjudication): 1", "Answers that were no JSON object (semantic analysis): 1"]
    assert got.usage.first()["n_calls"] == 3


def test_four_calls_at_a_time_in_order(spark):
    lock, now, most = threading.Lock(), [0], [0]

    def slow(system, user):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.03 if int(user) % 5 else 0.1)
        with lock:
            now[0] -= 1
        return user

    taken = []

    def rows():
        for i in range(40):
            taken.append(i)
            yield "s", str(i)

    clock = C.RetryClock()
    with ThreadPoolExecutor(4) as pool:
        got = C.in_order(pool, lambda s, u: C.ask_once(slow, clock, s, u, 0, 0.0), rows(), 8)
        first = next(got)
        assert len(taken) <= 9  # a reader that stops is not read ahead of
        answers = [first, *got]
    assert [a[0] for a in answers] == [str(i) for i in range(40)] and most[0] == 4


def test_one_clock_for_all_threads_of_a_worker():
    clock, times = C.RetryClock(), []

    def busy(system, user):
        times.append((user, time.monotonic()))
        if user == "a" and sum(u == "a" for u, _ in times) == 1:
            e = ConnectionError("HTTP 429")
            e.retry_after = 0.3
            raise e
        return "ok"

    began = time.monotonic()
    assert C.ask_once(busy, clock, "s", "a", 1, 0.0) == ("ok", None, 2, 1, 2)
    clock.hold(0.2)
    assert C.ask_once(busy, clock, "s", "b", 1, 0.0)[0] == "ok"
    assert times[1][1] - began >= 0.3 and times[2][1] - times[1][1] >= 0.2
    down = C.ask_once(lambda s, u: (_ for _ in ()).throw(TimeoutError("slow")), C.RetryClock(), "s", "u", 2, 0.0)
    assert down == (None, "TimeoutError: slow", 0, 0, 3) and C.ask_once(busy, clock, "s", None, 1, 0.0) is None


def test_asking_in_spark(spark):
    def factory():
        return lambda system, user: (user.upper(), -5, 7) if user != "bad" else 1 / 0

    rows = spark.createDataFrame([("a",), ("bad",), (None,), ("c" * 400,)], "user string").coalesce(1)
    asked = C.asking(factory)
    got = [r["c"] for r in rows.select(asked.call(F.lit("s"), F.col("user")).alias("c")).collect()]
    assert tuple(got[0]) == ("A", None, 0, 7, 1) and tuple(got[1]) == (None, "ZeroDivisionError: division by zero", 0, 0, 1)
    assert got[2] is None or got[2]["answer"] is None and got[2]["attempts"] is None
    assert got[3]["answer"] == "C" * 400
    plain = C.counted(lambda s, u: F.upper(u), lambda s, u: F.when(u == "bad", "E: x"))
    got = [r["c"] for r in rows.select(plain.call(F.lit("sys"), F.col("user")).alias("c")).collect()]
    assert tuple(got[0]) == ("A", None, 2, 1, 1) and tuple(got[1]) == (None, "E: x", 0, 0, 1) and got[2] is None
