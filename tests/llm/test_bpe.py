"""BPE by a pair occurrence index against the tokenizers library and against merging one pair at a time."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from lexweave.llm import bpe
from lexweave.llm.packing import default_tokenizer
from lexweave.llm.units import byte_vocabulary

PATH = default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
ALPHABET = " \n\t\x1c\x85\xa0　aab'stllve019é中文🙂́,.!?▁\x00<|>"


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(1500)]
    words = ["lower", "lowest", "newer", "wider", "aaaaaaaaa", "abababab", "mississippi", "東京", "don't", "x1y22"]
    made += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 400))) for _ in range(40)]
    return made + ["", " ", "<|endoftext|>", "a <|endoftext|> b", " <|endoftext|><|endoftext|>  x", "a" * 5000, " " * 3000 + "x", "ab" * 40000]


def of_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))


def test_round_trip_equals_the_library(spark):
    rows = list(enumerate(texts())) + [(7, None), (None, "no id"), (7, "again <|endoftext|>")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    for block in (1 << 25, 4000):
        got = sorted(tuple(r) for r in bpe.round_trip(docs, block=block).na.fill(-1, ["doc_id"]).collect())
        assert got == sorted((-1 if i is None else i, *of_library(t or "")) for i, t in rows)


def test_encode_and_decode_keep_columns(spark):
    made = texts()
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(made)], "doc_id long, text string, ids string")
    coded = bpe.encode(docs.drop("ids").withColumn("source", docs["doc_id"]), keep=("doc_id", "source"))
    back = {r["doc_id"]: r["text"] for r in bpe.decode(coded).collect()}
    assert back == dict(enumerate(made))
    assert coded.columns == ["doc_id", "source", "ids"]
    cut = spark.createDataFrame([(1, [byte_vocabulary(PATH).bytes.tolist()[0xC3]]), (2, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(cut).collect()} == {1: "�", 2: ""}


def test_pair_index_merges_as_one_pair_at_a_time_does():
    v = byte_vocabulary(PATH)
    rank = {(a, b): (r, m) for r, (a, b, m) in enumerate(v.merges.tolist())}

    def slow(word):
        ids = v.bytes[list(word)].tolist()
        while True:
            best = min(((rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank), default=None)
            if best is None:
                return ids
            i = best[1]
            ids[i : i + 2] = [rank[(ids[i], ids[i + 1])][1]]

    rng = random.Random(5)
    words = [bytes(rng.choice(b"aabcde  \xc3\xa9tion") for _ in range(rng.randrange(0, 30))) for _ in range(800)] + [b"", b"a", b"aaa", b"aaaa"]
    ids, ends = bpe.PairIndex(v).encode(words)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [slow(w) for w in words]


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_other_files_are_refused(tmp_path):
    bad = tmp_path / "x.json"
    bad.write_text('{"added_tokens": [], "normalizer": {"type": "NFC"}, "pre_tokenizer": null, "model": {"ignore_merges": false}}')
    with pytest.raises(ValueError, match="byte-level"):
        byte_vocabulary.__wrapped__(str(bad))
