"""Each operator against a brute-force version, with the odd rows: nulls, empty and long texts, repeats, no rows, extra columns."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from lexweave.llm import media, nearcopies, packing, simhash, warc

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length int, score double, rank int"


def texts():
    rng = np.random.default_rng(1)
    long = " ".join(rng.choice(WORDS, 20_000))
    base = [" ".join(rng.choice(WORDS, 60)) for _ in range(12)]
    return [None, "", "  \n\t", "One", *base, *base[:4], base[0] + " extra", long, long + " end", "é ß 漢字   x", "under the MIT license, under the mit license"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, 1, 2, 0.5, 3) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + rows[4:5], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(20)] + [(None, None, None), (3, None, None)], "doc_id long, quality int, toxic int")


def test_simhash(docs, empty):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = {i: brute(t) for i, t in enumerate(texts())}
    group = {i: i for i in want}
    for _ in want:
        group = {i: min(group[j] for j in want if (want[i] ^ want[j]).bit_count() <= 4) for i in want}
    rows = simhash.near_groups(docs).collect()
    assert len(rows) == len(want) + 1
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in rows} == {i: (want[i], group[i]) for i in want}
    assert simhash.near_groups(empty).count() == 0
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(group.values())


def test_simhash_hot_key(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(2)
    fps = {int(x) for x in rng.integers(0, 1 << 12, 200)}
    nodes = [(x, i) for i, x in enumerate(sorted(fps))]
    got = {(r["a"], r["b"]) for r in simhash.near_links(spark.createDataFrame(nodes, "fp long, node long")).collect()}
    want = [(i, j) for x, i in nodes for y, j in nodes if j < i and (x ^ y).bit_count() <= 4]

    def classes(edges):
        c = {i: i for _, i in nodes}
        for _ in range(20):
            for a, b in edges:
                c[a] = c[b] = min(c[a], c[b])
        return c

    assert classes(got) == classes(want)


def test_near_copies(spark, empty, monkeypatch):
    """Pairs at 0.8 to 1 are grouped, and less similar ones stay, also where a set is dealt over several chunks."""
    import corpus_pipeline

    rng = np.random.default_rng(6)
    rows = []
    for _ in range(20):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append(base)
        for edits in (1, 2, 3, 4, 6, 9):
            other = list(base)
            for at in rng.choice(200, edits, replace=False):
                other[at] = "changed"
            rows.append(other)
    sets = [{tuple(r[i : i + 5]) for i in range(196)} for r in rows]
    group = list(range(len(rows)))
    near = [(i, j) for i in group for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    for _ in rows:
        for i, j in near:
            group[i] = group[j] = min(group[i], group[j])
    table = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    for chunk in (256, 2):
        monkeypatch.setattr(nearcopies, "CHUNK", chunk)
        kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, table, "").collect()}
        assert kept == set(group) and 20 < len(kept) < len(rows)
    assert nearcopies.one_of_each_group(empty).count() == 0


def test_near_copies_keep_rows_without_or_with_equal_ids(spark):
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (1, "a b c d e f"), (2, "m n o p q r"), (2, "s t u v w x"), (2, "s t u v w x"), (None, None)]
    kept = simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, "a b c d e f"), (None, "g h i j k l"), (2, "m n o p q r"), (2, "s t u v w x"), (None, None)], key=str)


def test_packing(docs, empty):
    rows = packing.pack(docs).collect()
    spans, covered = {}, {}
    for r in rows:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        covered.setdefault(r["doc_id"], []).append(r["length"])
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    total = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert all(sum(v) == total[k] * (2 if k == 4 else 1) for k, v in covered.items())
    assert total[0] == total[1] == 1
    assert packing.pack(empty).count() == 0
    assert sum(n for _, n in packing.pack_histogram({512: 4})) == 2


def test_media(docs, empty):
    rows = {r["doc_id"]: r for r in media.features(media.store(docs)).collect()}
    for i, t in enumerate(texts()):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert rows[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and rows[i]["n_bytes"] == len(raw)
    assert media.features(media.store(empty)).count() == 0
    noise = np.random.default_rng(3).integers(0, 256, 192 * 40, dtype=np.uint8).tobytes()
    frame, end = media.parse(coded := media.encode([noise])[0])
    assert end == len(coded) and media.thumbnails([frame])[0].tobytes() == noise


def test_difference_hash_sees_all_rows_and_compares_means():
    for height in (1, 3, 8, 50):
        assert media.difference_hash(np.full((height, 192), 77, dtype=np.uint8)) == "0" * 16
    grey = np.full((64, 192), 100, dtype=np.uint8)
    for row in range(64):
        other = grey.copy()
        other[row, :21] = 255
        bits = int(media.difference_hash(other), 16)
        assert bits == 1 << (63 - 8 * (row // 8))






def test_warc(spark):
    rows = [(1, "http://a/", "x" * 1200), (2, "http://b/", "x" * 1200), (3, None, None), (4, "http://c/", "y")]
    got = {r["page_id"]: r for r in warc.archive_round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 2 and got[3]["payload_bytes"] == 0


def test_token_ids_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain, coder = Tokenizer.from_file(path), packing.Coder(path)
    rng = np.random.default_rng(5)
    odd = ["", " ", "\n\n  x\t y", "it's we'll I'M 12,345 ½ ٣٤", "<|endoftext|> in <|endoftext|>x", "a" * 5000, " " * 5000 + "b", "漢字かな交じり\u00a0文\u2028e\u0301", "\x00\x85\u3000 x", "🙂👍🏽 é"]
    odd += ["".join(chr(c) for c in rng.choice([32, 10, 39, 97, 115, 65, 49, 46, 0xE9, 0x4E2D, 0x1F642, 0xA0, 0x301], 400)) for _ in range(50)]
    assert coder.fast is not None
    for text in odd:
        assert coder.ids(text) == plain.encode(text, add_special_tokens=False).ids
