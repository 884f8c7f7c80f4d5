from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators.chunking import chunk, reassemble
from lexweave.operators.compare import flagged, sentence_pairs


def one(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expression).first()[0]


def test_normalize(spark):
    assert one(spark, T.normalize(F.col("t")), t="  a\r\nb\rc\n ") == "a\nb\nc\n"


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("t")), t=" One. Two!  Three? four ") == ["One.", "Two!", "Three?", "four"]


def test_legal_tiers(spark):
    for text, hits in (("Hello world.", 0), ("The party shall pay.", 2), ("WHEREAS the parties shall indemnify liability under this agreement.", 6)):
        assert one(spark, T.legal_hits(F.col("t")), t=text) == hits


def test_secrets_and_severity(spark):
    assert one(spark, T.redact_secrets(F.col("t")), t="API_KEY=abc x Bearer q") == "<redacted> x <redacted>"
    assert one(spark, T.severity(F.col("t")), t="odd") == "medium"
    assert one(spark, T.slide_markers(F.col("t")), t="-- 01 of 10 --") == "--- Slide 1 ---\n"


def test_chunks(spark):
    text = "# A\n\nOne. Two. Three.\n\nFour. Five.\n\n# B\n\nSix."
    rows = chunk(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", 25, 1).orderBy("chunk_index").collect()
    assert [r["text"] for r in rows][0].startswith("# A\n\nOne.")
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert chunk(spark.createDataFrame([(1, None)], "id long, text string"), "id", "text").count() == 0
    whole = reassemble(chunk(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", 25, 0), "id").first()["text"]
    assert whole == text + "\n"


def test_compare(spark):
    rows = spark.createDataFrame([(1, "The party shall pay within 30 days. Pay $100.", "The party may pay within 30 days. Pay $200. More.")], "id long, a string, b string")
    got = {r["sentence_index"]: r for r in flagged(sentence_pairs(rows, ["id"], "a", "b")).collect()}
    assert set(got) == {0, 1, 2}
    assert round(got[0]["similarity"], 2) == 91.18
    assert got[1]["protected_token_mismatch"] and got[2]["similarity"] == 0.0


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_common_subsequence():
    import random

    from lexweave.operators.compare import _common

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        return row[-1]

    random.seed(1)
    for _ in range(300):
        a, b = ("".join(random.choices("abc", k=random.randint(0, 12))) for _ in range(2))
        assert _common(a, b) == plain(a, b) == _common(b, a)
