"""Perplexities, discounts and thresholds against a plain version of the model."""

import math
from collections import Counter

import numpy as np
import pytest

from lexweave.llm import quality
from lexweave.llm.packing import default_tokenizer, shared_coder

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
SCHEMA = "doc_id long, lang string, text string, perplexity double, n long, row string"


def plain_discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    if not n[0] or not n[1]:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(k - 0.01, max(0.01, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else k * 0.5 for k in (1, 2, 3)]


def plain_perplexities(trusted, texts):
    coder = shared_coder(default_tokenizer())
    ids = lambda t: [-1, *coder.ids((t or "").lower())]
    c = Counter(p for t in trusted for p in zip(ids(t), ids(t)[1:]))
    d2 = plain_discounts(c.values())
    kinds = Counter(b for _, b in c)
    d1 = plain_discounts(kinds.values())
    own, gamma = Counter(), Counter()
    for (a, _), n in c.items():
        own[a] += n
        gamma[a] += d2[min(n, 3) - 1]
    rest = sum(d1[min(k, 3) - 1] for k in kinds.values()) / len(c) / coder.size
    p1 = lambda b: (kinds[b] - d1[min(kinds[b], 3) - 1]) / len(c) + rest if b in kinds else rest

    def p(a, b):
        if a not in own:
            return p1(b)
        n = c[a, b]
        return max(0, n - (d2[min(n, 3) - 1] if n else 0)) / own[a] + gamma[a] / own[a] * p1(b)

    out = []
    for t in texts:
        x = ids(t)
        out.append(math.exp(-sum(math.log(p(a, b)) for a, b in zip(x, x[1:])) / (len(x) - 1)) if len(x) > 1 else 1.0)
    return out, [sum(p(a, b) for b in range(coder.size)) for a in [-1, *list(own)[:2]]]


@pytest.mark.parametrize("head", [4, 1 << 16])
def test_perplexities_are_those_of_the_plain_model(spark, monkeypatch, head):
    """With all bigrams in the head, and with nearly all in the sharded join."""
    monkeypatch.setattr(quality, "HEAD", head)
    monkeypatch.setattr(quality, "GROUP", 500)
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(WORDS, rng.integers(1, 40))) + rng.choice(["", " 漢字", " été?"]) for _ in range(60)] + [None, "", "  \n", " ".join(rng.choice(WORDS, 3000))]
    rows = [(i, "en", t, 0.0, 1, "x") for i, t in enumerate(texts)] + [(5, "fr", texts[9], 0.0, 1, "x"), (None, None, texts[3], 0.0, 1, "x"), (5, "fr", texts[9], 0.0, 1, "x"), (None, None, None, 0.0, 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(None, 1), (1, None), (2, 0)], "doc_id long, quality int")
    digests = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "pmod(xxhash64('held out', coalesce(text, '')), 5) = 0 AS held").collect()
    trusted = [r["text"] for r in digests if r["doc_id"] is not None and r["doc_id"] < 60 and r["doc_id"] % 2 == 0 and not r["held"]]
    want, totals = plain_perplexities(trusted, [r[2] for r in rows])
    assert all(abs(t - 1) < 1e-9 for t in totals)
    got = quality.score(docs, marks).collect()
    assert len(got) == len(rows)
    key = lambda r: (str(r[0]), str(r[1]), round(r[2], 4))
    for g, w in zip(sorted(((r["doc_id"], r["lang"], r["perplexity"]) for r in got), key=key), sorted(((r[0], r[1], p) for r, p in zip(rows, want)), key=key)):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-5)
    assert all(r["kept"] for r in got if not r["n_tokens"])


def test_no_rows_and_no_labels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    marks = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.score(empty, marks).count() == 0
    docs = spark.createDataFrame([(1, "en", "some text", 0.0, 1, "x"), (2, "en", None, 0.0, 1, "x")], SCHEMA)
    got = quality.score(docs, marks.limit(0)).collect()
    assert len(got) == 2 and all(r["kept"] for r in got)


def test_thresholds_are_quantiles_of_held_out_trusted_text(spark):
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in range(300)]
    rows = [(i, "en", " ".join(rng.choice(words, 60)), 0.0, 1, "x") for i in range(400)] + [(1000 + i, "en", "".join(chr(x) for x in rng.integers(0x4E00, 0x9000, 200)), 0.0, 1, "x") for i in range(20)]
    marks = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in quality.score(docs, marks).collect()}
    held = {r["doc_id"] for r in docs.where("pmod(xxhash64('held out', text), 5) = 0 AND doc_id < 200").collect()}
    most = max(got[i]["perplexity"] for i in held) * quality.SLACK  # the 0.99 quantile of some forty is their largest
    assert all(r["kept"] == (r["perplexity"] <= most) for r in got.values())
    assert np.mean([got[i]["kept"] for i in range(400)]) > 0.95 and not any(got[1000 + i]["kept"] for i in range(20))
