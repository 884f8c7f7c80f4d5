"""Table functions of SQL against the column forms."""

import random

from pyspark.sql import functions as F

from lexweave.functions.tables import register
from lexweave.functions.text import sentences
from lexweave.operators.chunking import chunk


def texts():
    rng = random.Random(4)
    parts = ["# Title\n", "## Next one\n\n", "A sentence. ", "Is it? Yes! ", "\n\n", "\r\n \r\n", "Ünïcode　text. ", "x" * 700 + ". ", "\t", "-", "#no heading\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(150)] + [None, "", "  \n", "one", "#", "# only", "word. " * 3000]


def test_chunks_and_sentences_of_a_table(spark):
    register(spark)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts())], "doc_id long, text string, chunk_index string")
    docs.createOrReplaceTempView("texts")
    for table in ("TABLE(SELECT doc_id AS key, text, chunk_index FROM texts) PARTITION BY key", "TABLE(SELECT chunk_index, text, doc_id AS key FROM texts)"):
        got = sorted(tuple(r) for r in spark.sql(f"SELECT CAST(key AS LONG), chunk_index, text, heading_context FROM chunks({table})").collect())
        assert got == sorted(tuple(r) for r in chunk(docs, "doc_id", "text").collect())
        got = sorted(tuple(r) for r in spark.sql(f"SELECT CAST(key AS LONG), sentence_index, sentence FROM sentences({table})").collect())
        assert got == sorted(tuple(r) for r in docs.select("doc_id", F.posexplode(sentences(F.col("text")))).collect())
    joined = spark.sql("SELECT count(*) AS n FROM texts t JOIN chunks(TABLE(SELECT doc_id AS key, text FROM texts) PARTITION BY key) c ON c.key = t.doc_id").first()["n"]
    assert joined == chunk(docs, "doc_id", "text").count()
    assert spark.sql("SELECT * FROM chunks(TABLE(SELECT doc_id AS key, text FROM texts WHERE doc_id < 0) PARTITION BY key)").collect() == []
