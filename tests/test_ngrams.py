"""Languages by character n-grams: held-out accuracy, scores against a plain count, odd rows, whole jobs with a profile."""

import itertools
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexweave.operators import completion as C
from lexweave.operators import ngrams as N
from lexweave.plans import service as S

LABELLED = [
    ("en", "The cat and the dog are in the house with the other animals of the farm."), ("en", "This is what we want to do with that thing there."),
    ("de", "Der Hund und die Katze sind nicht in dem Haus, das wir mit der Familie haben."), ("de", "Das ist nicht, was wir mit dieser Sache dort machen wollen."),
    ("es", "El perro y la casa que los niños en el pueblo tienen para las fiestas del año."), ("es", "Esto no es lo que queremos hacer con esa cosa."), (None, "unlabelled text"),
]


def grams(word):
    w = f" {word} "
    return [w[i : i + k] for i in range(len(word) + 1) for k in (1, 2, 3) if len(w[i : i + k]) == k and not (k == 1 and i == 0)]


def plain(labelled, text, size):
    """Language and confidence by counting."""
    counts = {}
    for lang, t in labelled:
        if lang is not None:
            c = counts.setdefault(lang, Counter())
            for w in filter(None, re.split(r"[^\w]+|[\d_]+", t.lower())):
                c.update(grams(w))
    kept = {lang: dict(sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:size]) for lang, c in counts.items()}
    known = set().union(*kept.values())
    own = [g for w in set(filter(None, re.split(r"[^\w]+|[\d_]+", text.lower()))) for g in grams(w) if g in known]
    if not own:
        return None
    score = {lang: sum(round(1000 * math.log((k.get(g, 0) + 0.5) / (sum(k.values()) + size / 2))) for g in own) for lang, k in kept.items()}
    best = min(score, key=lambda lang: (-score[lang], lang))
    return best, round(1 / sum(math.exp((s - score[best]) / (1000 * math.sqrt(len(own)))) for s in score.values()), 4)


def profile_of(spark, rows=LABELLED, size=N.SIZE):
    return N.profile(spark.createDataFrame(rows, "lang string, text string"), size)


@pytest.mark.parametrize("size", [15, N.SIZE])
def test_scores_equal_a_plain_count(spark, size):
    texts = ["The dog wants that house and the other thing there, friend.", "Wir haben dieses Haus nicht für die Katze gemacht, mein Freund.", "Los niños quieren el perro de la casa del pueblo, amigo mío.", "zzzz qqqq xxxx jjjj wwww vvvv kkkk yyyy 12345 67890", "the der el " * 8]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["found"] and tuple(r["found"]) for r in N.detect(docs, "text", profile_of(spark, size=size)).collect()}
    assert got == {i: plain(LABELLED, t, size) for i, t in enumerate(texts)}


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "short"), (3, "Этот документ написан на русском языке, и его надо перевести сегодня."), (4, "1234 5678 " * 20), (5, "the house and the dog in the farm " * 3000)]
    docs = spark.createDataFrame(rows, "sample long, text string").withColumns({"gram": F.lit("x"), "place": F.lit(7), "row": F.lit(1)})
    got = N.detect(docs, "text", profile_of(spark)).collect()
    assert len(got) == len(rows) and all(r["gram"] == "x" and r["place"] == 7 and r["row"] == 1 for r in got)
    found = {r["sample"]: r["found"] for r in got}
    assert found[1] is None and found[None] is None and found[2] is None and found[4] is None and found[3]["lang"] == "ru" and found[5]["lang"] == "en" and found[5]["confidence"] > 0.9
    nothing = N.profile(spark.createDataFrame([], "lang string, text string"))
    assert nothing.languages == [] and {r["sample"]: r["found"] for r in N.detect(docs, "text", nothing).collect()}[3]["lang"] == "ru"
    assert N.detect(docs.limit(0), "text", profile_of(spark)).collect() == []
    with pytest.raises(ValueError, match="languages"):
        N.profile(spark.createDataFrame([(f"l{i}", "x") for i in range(65)], "lang string, text string"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = N.detect(docs.where(~fold), "text", N.profile(docs.where(fold).select("lang", "text"))).collect()
    said = [r for r in rows if r["found"] is not None]
    right = sum(r["found"]["lang"] == r["lang"] for r in said)
    assert right >= 0.98 * len(said) and len(said) >= 0.97 * len(rows), (right, len(said), len(rows))
    sure = [r for r in said if r["found"]["confidence"] >= 0.85]
    assert sum(r["found"]["lang"] == r["lang"] for r in sure) >= 0.99 * len(sure) and len(sure) >= 0.9 * len(said)


def test_jobs_with_a_profile(spark, tmp_path):
    names = itertools.count()

    def save(df, name):
        at = f"{tmp_path}/{name}{next(names)}"
        df.write.parquet(at)
        return spark.read.parquet(at)

    docs = spark.createDataFrame([(1, "Wir haben dieses Haus nicht für die Katze und die anderen Tiere gemacht."), (2, "The house of the dog is there with the other animals.")], "doc_id long, text string")
    got = S.run(docs, C.mock(), S.Options(), save=save, profile=profile_of(spark))
    assert {r["doc_id"]: (r["source_lang"], r["skipped"]) for r in got.outputs.collect()} == {1: ("de", False), 2: ("en", True)}
