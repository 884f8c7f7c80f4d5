"""Quotas of the splitting tree, and what documents give, against plain sums."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lexweave.llm import mixing
from lexweave.llm.registry import QUERIES

#: What the query returns but for the shards, which are drawn.
TAKEN = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || CAST(doc_id AS VARCHAR)) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM s
), r AS (
  SELECT *, row_number() OVER o AS k, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - (CAST(sum(2 * source_size) OVER o AS DOUBLE) - 2 * source_size))
         / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS level, 2.0 * source_size / weight AS ratio
  FROM w
  WINDOW o AS (ORDER BY 2.0 * source_size / weight, place ROWS UNBOUNDED PRECEDING)
), t AS (
  SELECT source, source_size, least(2.0 * source_size, weight * (SELECT arg_min(level, k) FROM r WHERE level <= ratio)) AS target FROM r
), q AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS passes,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) % source_size ELSE 0 END AS rest
  FROM t
)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(size, rest - (sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size))) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""

SCHEMA = "doc_id long, text string, source string, size long, taken long, block int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def rows(n=600):
    rng = np.random.default_rng(1)
    out = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "b", "c", "d", None][int(rng.choice(5, p=[0.5, 0.2, 0.1, 0.1, 0.1]))]) for i in range(n)]
    return out + [(n, None, "a"), (n + 1, "", None), (None, "x y z", "b"), (5, "one two", "c"), (5, "one two", "c"), (n + 2, "w " * 5000, "e")]


def test_tree_parts_quotas_exactly():
    quotas = np.array([4096, 17, 0, 1, 900])
    for shards in (1, 3, 64):
        out = mixing.splitting_tree(quotas, shards, 7)
        assert out.shape == (shards, 5) and (out >= 0).all() and (out.sum(axis=0) == quotas).all()
        assert out.sum(axis=1).max() - out.sum(axis=1).min() <= np.ceil(np.log2(shards)) + 1
        assert (out == mixing.splitting_tree(quotas, shards, 7)).all()


@pytest.mark.parametrize("limit", [100_000, 0])
def test_documents_give_what_their_source_owes(spark, monkeypatch, limit):
    """Also where the sources are too many to be sent to all tasks."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    data = rows()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = mixing.mix(frame(spark, data).withColumnsRenamed({"size": "size_", "taken": "taken_", "block": "block_"})).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in data)
    sources = sorted({s for _, _, s in data}, key=lambda s: (s is None, s))
    sizes = [sum(size(t) for _, t, x in data if x == s) for s in sources]
    want = mixing.targets(sizes, mixing.MixPlan())
    assert sum(want) == pytest.approx(min(1.5 * sum(sizes), 2.0 * sum(sizes)))
    by = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source_size"], round(r["target"], 6)] += r["taken"]
        assert len(r["shards"]) == -(-r["taken"] // r["size"]) if r["size"] else r["shards"] == [] and r["taken"] == 0
        assert all(0 <= s < 64 for s in r["shards"])
    assert by == {(n, round(t, 6)): int(t + 0.5) for n, t in zip(sizes, want)}
    again = mixing.mix(frame(spark, data[::-1])).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))


def test_shards_get_disjoint_runs_of_the_blocks(spark):
    plan = mixing.MixPlan(shards=4)
    got = mixing.mix(frame(spark, rows(300)), plan, keep=["text"]).collect()
    used = Counter(s for r in got for s in r["shards"])
    assert set(used) == {0, 1, 2, 3} and sum(used.values()) == sum(-(-r["taken"] // r["size"]) for r in got if r["size"])


def test_mix_keeps_whole_rows(spark):
    data = frame(spark, rows(100))
    out = mixing.mixed_documents(data)
    assert out.columns == data.columns
    of = Counter(map(tuple, data.collect()))
    assert all(n <= 2 * of[r] for r, n in Counter(map(tuple, out.collect())).items())
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed_documents(frame(spark, [])).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    names = ["doc_id", "size", "source_size", "target", "taken"]
    got = sorted(tuple(r) for r in QUERIES["op7_mixing"](spark, sf).select(*names).collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
        want = sorted(db.execute(f"SELECT {', '.join(names)} FROM ({TAKEN})").fetchall())
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])


def by_hand(data, plan, tree):
    """doc_id -> shards: every unit of a source is laid in order and handed to shards by the tree's counts, document by document."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in data}, key=lambda s: (s is None, s))
    sizes = [sum(size(t) for _, t, x in data if x == s) for s in sources]
    out, quotas, edges = {}, [], []
    for s, n, target in zip(sources, sizes, mixing.targets(sizes, plan)):
        docs = sorted((hashlib.md5(f"{plan.seed}:{i}".encode()).hexdigest(), size(t), i) for i, t, x in data if x == s)
        quota, passes, rest, end, part = int(target + 0.5), 0, 0, -1, {}
        if n:
            passes, rest = divmod(quota, n)
        for key, words, i in docs:
            part[i] = min(words, rest)
            rest -= part[i]
            if part[i]:
                end = int(key[:3], 16)
        quotas.append(passes * mixing.BLOCKS + end + 1)
        edges.append((docs, passes, end, part))
    counts = tree(np.array(quotas, dtype=np.int64))
    for at, (docs, passes, end, part) in enumerate(edges):
        owner = [shard for shard in range(plan.shards) for _ in range(counts[shard][at])]
        for key, words, i in docs:
            block = int(key[:3], 16)
            units = [p * mixing.BLOCKS + block for p in range(passes)] + ([passes * mixing.BLOCKS + block] if part[i] else [])
            out[i] = [owner[u] for u in units] if words else []
    return out


@pytest.mark.parametrize("stratum", [1024, 2])
def test_shards_against_dealing_by_hand(spark, monkeypatch, stratum):
    monkeypatch.setattr(mixing, "STRATUM", stratum)
    plan = mixing.MixPlan(shards=5)
    data = [r for r in rows(300) if r[0] is not None and r[0] != 5]
    seed = mixing._number(plan.seed)
    tree = lambda q: np.hstack([mixing.splitting_tree(q[i : i + stratum], plan.shards, seed, i // stratum) for i in range(0, len(q), stratum)])
    got = {r["doc_id"]: r["shards"] for r in mixing.mix(frame(spark, data).select("doc_id", "text", "source"), plan).collect()}
    assert got == by_hand(data, plan, tree)
    monkeypatch.setattr(mixing, "_number", lambda seed: 11)
    other = {r["doc_id"]: r["shards"] for r in mixing.mix(frame(spark, data).select("doc_id", "text", "source"), plan).collect()}
    assert other != got and {i: len(s) for i, s in other.items()} == {i: len(s) for i, s in got.items()}


def test_sources_beyond_one_draw(spark):
    """130,000 sources of a word each: the units of all are more than one draw of numpy takes."""
    got = mixing.mix(spark.range(130_000).selectExpr("id AS doc_id", "'w' AS text", "concat('s', id) AS source"))
    row = got.selectExpr("count(*) AS n", "sum(taken) AS taken", "max(taken) AS most", "count_if(size(shards) <> taken) AS odd").first()
    assert row["n"] == 130_000 and row["most"] <= 2 and row["odd"] == 0 and abs(row["taken"] - 195_000) <= 65_000


def test_pieces_of_shards_are_one_shuffled_shard(spark, monkeypatch):
    data = frame(spark, rows(300))
    whole = Counter(map(tuple, mixing.mixed_documents(data).collect()))
    monkeypatch.setattr(mixing, "PIECE_WORDS", 20)
    cut = mixing.mixed_documents(data)
    assert Counter(map(tuple, cut.collect())) == whole and cut.rdd.getNumPartitions() > 64
