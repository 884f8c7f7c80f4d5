"""The risk estimator against a plain version, accuracy on planted words, odd rows."""

import numpy as np
import pytest

from lexweave.llm import toxicity

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
SCHEMA = "doc_id long, text string, held_out string, score double, predicted int, kind string"


def risk(xp, xu, prior, w, b):
    """pi E_p[l+] and E_u[l-] - pi E_p[l-], with the logistic loss."""
    loss = lambda x, y: np.mean([np.log1p(np.exp(-y * (np.dot(r, w) + b))) for r in x])
    return prior * loss(xp, 1), loss(xu, -1) - prior * loss(xp, -1)


@pytest.mark.parametrize("negative", [False, True])
def test_steps_follow_the_non_negative_risk(negative):
    """One step goes down the gradient of the risk, or up that of its negative part where that is below zero."""
    rng = np.random.default_rng(1)
    xp, xu = rng.integers(0, 2, (30, 4)), rng.integers(0, 2, (80, 4))
    if negative:
        xu = np.zeros_like(xu)
        xp[:] = 1
    prior = 0.3
    w0, b0 = np.zeros(4), np.log(prior / (1 - prior))
    if negative:  # start where the unlabelled look negative and the positives too
        b0 = np.log(0.9 / 0.1)
        prior = 0.9
    w, b = toxicity.fit_nnpu(xp, xu, prior, rounds=1, rate=1e-3, decay=0.0)
    first, rest = risk(xp, xu, prior, w0, b0)
    numeric = []
    for i in range(5):
        up, down = np.append(w0, b0), np.append(w0, b0)
        up[i] += 1e-6
        down[i] -= 1e-6
        a, c = risk(xp, xu, prior, up[:4], up[4]), risk(xp, xu, prior, down[:4], down[4])
        numeric.append((sum(a) - sum(c)) / 2e-6 if rest >= 0 else -(a[1] - c[1]) / 2e-6)
    step = np.append(w, b) - np.append(w0, b0)
    clear = np.abs(numeric) > 1e-6
    assert clear.any() and (np.sign(step[clear]) == -np.sign(np.array(numeric)[clear])).all()


def test_planted_words_are_learned_from_the_training_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(WORDS, 30)) + (" vile nasty" if i % 4 == 0 else ""), "", 0.0, 1, "") for i in range(400)]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    got = toxicity.score(docs, marks).collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["held_out"]]) > 0.95
    # Labels of held-out rows change nothing.
    flipped = marks.selectExpr("doc_id", "IF(pmod(crc32(CAST(doc_id AS STRING)), 3) = 1, 1 - toxic, toxic) AS toxic")
    assert sorted(map(str, got)) == sorted(map(str, toxicity.score(docs, flipped).collect()))


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(WORDS, 20)) + (" vile" if i % 3 == 0 else ""), "x", 0.5, 1, "k") for i in range(60)]
    rows += [(None, "vile vile", "x", 0.5, 1, "k"), (None, None, "x", 0.5, 1, "k"), (1, "", "x", 0.5, 1, "k"), rows[0], (2, "word " * 50_000, None, 0.5, 1, "k")]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, marks, keep=["text"]).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got) and all(not r["held_out"] for r in got if r["doc_id"] is None)
    by = {}
    for r in got:
        assert by.setdefault(r["text"] or "", r["score"]) == r["score"]
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    assert toxicity.score(docs.limit(0), marks).count() == 0
    bare = toxicity.score(docs, marks.limit(0)).collect()
    assert len(bare) == len(rows) and len({r["score"] for r in bare}) == 1


def test_places_are_those_of_the_features():
    rng = np.random.default_rng(6)
    letters = list("abcé 漢")
    texts = ["".join(rng.choice(letters, 200)) for _ in range(30)]
    kinds = sorted(set().union(*map(toxicity.features_of, texts)))
    chosen = tuple(kinds[i] for i in rng.choice(len(kinds), len(kinds) // 4, replace=False))
    index = toxicity.Index(chosen)
    for t in texts:
        assert index.places(t) == sorted(chosen.index(x) for x in toxicity.features_of(t) if x in chosen)


def test_repeated_ids_are_sampled_once(spark):
    """However many rows share an id, the driver reads one of its texts for each kind."""
    docs = spark.range(200).selectExpr("id % 10 AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(10).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    sample, prior = toxicity._sampled(docs, labels)
    rows = sample.collect()
    assert sum(r["kind"] == "u" for r in rows) == 10 and 0 < prior < 1
    assert 0 < sum(r["kind"] != "u" for r in rows) <= 10


def test_texts_go_to_python_once_and_rows_do_not(spark):
    """Scoring sends a text and gets a number back; the kept row, which holds the text again, stays with Spark."""
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('fine text ', id, IF(id % 4 = 0, ' vile', '')) AS text", "repeat('x', 100) AS source")
    marks = spark.range(40).selectExpr("id AS doc_id", "CAST(id % 4 = 0 AS int) AS toxic")
    kept = toxicity.without_toxic(docs, marks)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython [") == 1
    assert 0 < kept.count() < 40
