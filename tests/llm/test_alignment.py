"""The alignment against a plain one of whole documents."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from lexweave.llm import alignment
from lexweave.llm.units import byte_of

A = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=str(P.path("piece_bpe_32k.model")))
BYTE = {c: bytes([b]) for c, b in byte_of().items()}
ALPHABET = " \n\t\x1c\x85\xa0　aab'stllve019é中文🙂́,.!?\x00<|>"


def tokens(text):
    """Ids and byte ends by A and B, or nothing."""
    if not text:
        return [], [], [], []
    a = A.encode(" " + text, add_special_tokens=False)
    b = B.encode(text)
    ta = [b"".join(BYTE[c] for c in A.id_to_token(i)) for i in a.ids]
    tb = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, B.id_to_piece(i)) for i in b)]
    whole = (" " + text).encode()
    if b"".join(ta) != whole or b"".join(tb) != whole:
        return [], [], [], []
    ends = lambda t: [sum(map(len, t[: i + 1])) for i in range(len(t))]
    return a.ids, ends(ta), b, ends(tb)


def plain(texts):
    made, held = [], Counter()
    for text in texts:
        a, ea, b, eb = tokens(text)
        cuts = sorted(set(ea) & set(eb))
        groups = ";".join(",".join(str(i) for i, e in zip(a, ea) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(b, eb) if lo < e <= hi) for lo, hi in zip([0, *cuts], cuts))
        links, j = [], 0
        for i, (s, e) in enumerate(zip([0, *ea], ea)):
            while eb[j] <= s:
                j += 1
            k = j
            while k < len(b) and (eb[k - 1] if k else 0) < e:
                links.append((a[i], b[k]))
                k += 1
        made.append((len(a), len(b), len(cuts), links, hashlib.sha256(groups.encode()).hexdigest() if a else ""))
        held.update(set(links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(na, nb, ng, len(x), sum(held[p] == best[p[0]] for p in x), sum(held[p] for p in x), sha) for na, nb, ng, x, sha in made]


def found(docs, **options):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in columns) for r in alignment.align(docs, **options).collect())


def test_alignment_equals_a_plain_one_of_whole_texts(spark):
    rng = random.Random(11)
    words = ["The", "internationalisation", "naïve", "東京都", "don't", "x1y22", "2024-01-02", "https://example.org/a?b=c", "word.\nNext", "é", "​z", "aaaa"]
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += [None, "", " ", "  ", "a", "▁", "x▁y z", "<|endoftext|> <s> <0x41>", "  two  blanks \n end ", "q" * 3000, "same text here", "same text here"]
    rows = [(i if i % 50 else None if i % 100 else 7, t, "x", 5) for i, t in enumerate(texts)]
    want = sorted((-1 if r[0] is None else r[0], *p) for r, p in zip(rows, plain(texts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups string, n_a int")
    for block in (alignment.BLOCK, 1500):
        assert found(docs, block=block) == want


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_units_of_equal_byte_lengths_are_aligned_once(spark):
    words = ["".join(x) for x in zip("abcdefghij" * 60, "klmnopqrst" * 60, "".join(c * 10 for c in "uvwxyzabcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyzab"))]
    coded = alignment.coded(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[::-1]))], "doc_id long, text string").coalesce(1))
    units = sum(len(r["shapes"]) for r in coded.where("slice IS NOT NULL").collect())
    shapes = coded.where("shape IS NOT NULL").select("a_bytes", "b_bytes").collect()
    assert units == len(set(words)) and len(shapes) == len({(*r["a_bytes"], 0, *r["b_bytes"]) for r in shapes}) < 20


def test_pairs_are_counted_once_a_document_however_documents_are_sliced(monkeypatch):
    rng, k = random.Random(3), 7
    units = [[rng.randrange(k) for _ in range(rng.randrange(1, 5))] for _ in range(12)]
    docs = [[rng.randrange(12) for _ in range(rng.choice([0, 1, 3, 30]))] for _ in range(40)]
    want = Counter(p for d in docs for p in {p for u in d for p in units[u]})
    sizes = np.array(list(map(len, units)))
    for most in (1, 10, 1000):
        monkeypatch.setattr(alignment, "LINKS", most)
        got = alignment._documents_with(np.concatenate(units), np.cumsum(sizes) - sizes, sizes, np.concatenate(docs).astype(int), np.cumsum([0, *map(len, docs)]), k)
        assert got.tolist() == [want[p] for p in range(k)]
