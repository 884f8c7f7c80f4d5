"""The corpus pipeline: each stage against a plain version of its decision, the whole against its parts, odd rows."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lexweave.llm import lines, mixing, packing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    own = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n))
    passage = ". ".join(own(15) for _ in range(5)) + "."
    rows = [(i, ". ".join(own(12) for _ in range(12)) + "." + (" vile nasty scum" if i % 5 == 0 else ""), "en", f"s{i % 3}", 9) for i in range(100)]
    rows += [(200 + i, f"{'. '.join(own(12) for _ in range(12))}. {passage}", "en", "s1", 9) for i in range(3)]
    rows += [(300, rows[1][1], "en", "s1", 9), (301, rows[2][1].replace(rows[2][1].split()[70], "changed"), "en", None, 9)]
    rows += [(None, None, None, None, None), (None, own(30), "en", "s2", 9), (303, "", "en", "s1", 0), (303, "other " + own(40), "en", "s1", 0), rows[7]]
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    marks = [(i, int(i % 5 != 0), int(i % 5 == 0)) for i in range(100)] + [(None, 1, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), passage


def test_stages_and_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]


def test_each_stage_decides_on_what_its_predecessor_kept(spark, folder):
    at, passage = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    labels = spark.read.parquet(f"{at}/labels.parquet")
    everything = Counter(map(tuple, docs.collect()))
    scored = toxicity.score(docs, labels, keep=["text"]).collect()
    calm = corpus_pipeline.drop_toxic(spark, docs, at)
    assert calm.columns == docs.columns
    kept = Counter(map(tuple, calm.collect()))
    assert not kept - everything and sum(kept.values()) == sum(r["predicted"] == 0 for r in scored) < len(scored)
    assert {r["doc_id"] for r in scored if r["predicted"]} <= {i for i in range(0, 100, 5)}

    trimmed = corpus_pipeline.drop_lines(spark, calm, at)
    assert trimmed.columns == docs.columns and trimmed.count() == calm.count()
    assert sum(passage in (r["text"] or "") for r in trimmed.collect()) == 1
    assert Counter(str(r["text"]) for r in trimmed.collect()) == Counter(str(r["text"]) for r in lines.drop_recurring(calm).collect())

    single = corpus_pipeline.drop_near_duplicates(spark, trimmed, at)
    rows = trimmed.collect()
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((r["text"] or "").lower().split() for r in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = grams[i] & grams[j]
            if grams[i] == grams[j] or len(both) >= 0.8 * len(grams[i] | grams[j]):
                group = [group[i] if g == group[j] else g for g in group]
    left = [tuple(r) for r in single.collect()]
    assert single.columns == docs.columns and len(left) == len(set(group))
    assert not Counter(left) - Counter(map(tuple, rows))

    mixed = corpus_pipeline.mix_sources(spark, single, at)
    plan = {r["doc_id"]: r for r in mixing.mix(single).where("doc_id IS NOT NULL").collect()}
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert all(abs(copies[i] - r["taken"] / r["size"]) < 1 for i, r in plan.items() if r["size"] and i != 303)

    packed = corpus_pipeline.pack(spark, mixed, at).collect()
    tokens = {r["doc_id"]: r["doc_tokens"] for r in packed}
    assert all(sum(r["length"] for r in packed if r["doc_id"] == i) == copies[i] * n for i, n in tokens.items() if i not in (None, 303))
    whole = [tuple(r) for r in corpus_pipeline.run(spark, at).collect()]
    assert sorted(whole, key=str) == sorted(map(tuple, packed), key=str)


def test_no_documents(spark, folder, tmp_path):
    at, _ = folder
    spark.read.parquet(f"{at}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{at}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_packing_covers_every_id_once(spark):
    """Ids, checksums and places against the tokenizers library."""
    import zlib

    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.default_tokenizer())
    rng = np.random.default_rng(2)
    texts = [None, "", "one", "é 漢字 x", *[" ".join(rng.choice(["alpha", "beta", "gamma"], int(n))) for n in rng.integers(1, 3000, 20)]]
    docs = spark.createDataFrame([(i, t, "en", 1, 2, 3) for i, t in enumerate(texts)] + [(None, "two words", "en", 1, 2, 3)], "doc_id long, text string, lang string, start int, length int, bucket int")
    rows = packing.pack(docs).collect()
    for i, t in [*enumerate(texts), (None, "two words")]:
        ids = np.array(coder.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()] and sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids) for r in own)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(held) == list(range(len(held)))
    for spans in held.values():
        ends = 0
        for offset, length in sorted(spans):
            assert offset == ends
            ends += length
        assert ends <= 1024


def test_scratch_is_dropped(spark):
    from lexweave.llm import common

    kept = common.materialize(spark.range(3).toDF("doc_id"), "kept")
    assert kept.count() == 3
    common.drop_scratch(spark)
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found|PATH_NOT_FOUND|FileNotFound"):
        spark.read.parquet(kept.inputFiles()[0]).count()


def test_near_duplicates_are_those_of_simhash_too(spark):
    """Texts that repeat one passage and end otherwise: op3 links them, though few of their different five-word runs are equal."""
    from lexweave.llm import simhash

    ends = [" ".join(f"{name}{i}" for i in range(10)) for name in ("x", "y", "z")]
    rows = [(7, "one two three four five " * 60 + ends[0]), (3, "One two three four five " * 60 + ends[1]), (9, "six seven eight nine ten " * 60 + ends[2]), (None, "one two three four five " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert groups == {7: 3, 3: 3, 9: 9, None: 3}
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [3, 9]


def test_stages_send_batches_of_bounded_bytes(spark, folder):
    """Large texts go to Python a few at a time; a size that the session's owner has set stays."""
    own, at = spark.newSession(), folder[0]
    key, texts = "spark.sql.execution.arrow.maxBytesPerBatch", "SELECT repeat('x', 1 << 20) AS text FROM range(0, 24, 1, 1)"
    sizes = lambda: [r["n"] for r in own.sql(texts).mapInArrow(rows_of_batches, "n long").collect()]
    assert max(sizes()) > 8
    corpus_pipeline.STAGES[0][1](own, own.read.parquet(f"{at}/documents.parquet"), at)
    assert sum(sizes()) == 24 and max(sizes()) <= 8
    other = spark.newSession()
    other.conf.set(key, "1m")
    corpus_pipeline.STAGES[0][1](other, other.read.parquet(f"{at}/documents.parquet"), at)
    assert other.conf.get(key) == "1m"


def rows_of_batches(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})
