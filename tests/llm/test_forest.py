"""Recall against brute force, and the rows that take no part."""

import numpy as np
import pytest

from lexweave.llm import forest

SCHEMA = "vec_id long, embedding array<float>, score double, rank int, entry long"


def brute(x, every=20):
    out = {}
    for q in range(0, len(x), every):
        s = x @ x[q]
        s[q] = -np.inf
        out[q] = s
    return out


def recall(got, x):
    want, hits = brute(x), 0
    for q, s in want.items():
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        hits += sum(r["score"] >= np.sort(s)[-20] - 1e-9 for r in own)
    assert len(got) == 20 * len(want)
    return hits / 20 / len(want)


def test_odd_rows(spark):
    x = np.random.default_rng(5).standard_normal((300, 8)).astype(np.float32).astype(float)
    x[7] = x[8] = x[40]
    x[60:200] = x[60]  # many ties, more than are asked for
    odd = [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (320, [None] * 8), (340, []), (None, x[3].tolist()), (341, [9.0] * 5)]
    repeated = [(5, x[5].tolist()), (9, [99.0] * 8)]  # the second is not the smallest of its id's vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd + repeated
    got = forest.nearest(spark.createDataFrame([(*r, 0.5, 1, 2) for r in rows], SCHEMA)).collect()
    assert recall(got, x) >= 0.9
    assert forest.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    few = forest.nearest(spark.createDataFrame([(20, [1.0, 0.0], 0.0, 1, 1), (21, [1.0, 1.0], 0.0, 1, 1)], SCHEMA)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few] == [(20, 1, 21, 1.0)]


@pytest.mark.parametrize("n,cell", [(500, 8192), (2000, 8192), (3000, 128), (3000, 16)])
def test_recall_on_isotropic_vectors(spark, monkeypatch, n, cell):
    """With small cells, also where cells are crowded and dealt over parts."""
    monkeypatch.setattr(forest, "CELL", cell)
    x = np.random.default_rng(n).standard_normal((n, 64)).astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, v.tolist(), 0.0, 1, 1) for i, v in enumerate(x)], SCHEMA)
    assert recall(forest.nearest(table).collect(), x) >= 0.93
