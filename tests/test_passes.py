"""How often plans read their input and what they move: each text is read once, no gram is exploded or shuffled."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import detect as D
from lexweave.operators import ngrams as N
from lexweave.operators.completion import mock
from lexweave.operators.reconcile import discrepancies
from lexweave.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_grams_stay_in_their_task(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    made = plan(N.detect(docs, "text", N.profile(docs)))
    assert made.count("Relation [") == 1 and not any(x in made for x in ("Generate", "Join", "Aggregate"))


@pytest.mark.parametrize("name", ["compare_passes", "mock_translate_quick"])
def test_texts_are_read_once(spark, name):
    assert plan(catalog.QUERIES[name](spark, SF)).count("Relation [") == 1


def test_equivalent_and_other_sentences_are_one_pass(spark):
    assert plan(discrepancies(catalog._two_passes(spark, SF), mock())).count("Relation [") == 1


def test_legal_hits_and_scripts_as_by_plain_patterns(spark):
    texts = ["WHEREAS the Parties; Governing Law, indemnifies", "partys CONTRACTor agreement. shall", "Kelvin K, İndemnif", "漢字かなカナ mixed " * 9, "한국어 " * 20, "Русский текст и слова " * 3, "שלום עולם " * 9, "مرحبا بالعالم " * 9, "Grüße, 12", ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = sum((F.regexp_like("text", F.lit(p)).cast("int") for p in T.LEGAL_PATTERNS), F.lit(0))
    letters = F.greatest(F.regexp_count("text", F.lit(r"\p{L}")), F.lit(1))
    shares = F.array(*[F.struct(F.lit(c).alias("lang"), F.least(F.lit(1.0), F.regexp_count("text", F.lit(p)) / letters).alias("confidence")) for c, p in D.SCRIPTS.items()])
    rows = docs.select(plain.alias("hits"), T.legal_hits(F.col("text")).alias("got"), F.get(F.filter(shares, lambda x: x["confidence"] >= D.SCRIPT_SHARE), F.lit(0)).alias("script"), D.script_of(F.col("text")).alias("found")).collect()
    assert [r["got"] for r in rows] == [r["hits"] for r in rows]
    assert [r["found"] and tuple(r["found"]) for r in rows] == [r["script"] and tuple(r["script"]) for r in rows]
    assert sum(r["found"] is not None for r in rows) == 5
