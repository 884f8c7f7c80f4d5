"""Places, labels and scores against a plain search of every start."""

import re

import numpy as np
import pytest

from lexweave.llm import licenses

SCHEMA = "doc_id long, text string, labels string, score double, n_words int"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_base(text):
    w = words(text)
    return sorted((i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p)


def notice(label):
    return licenses.NOTICES[label].replace("|", " ")


def texts():
    rng = np.random.default_rng(1)
    filler = ["the", "license", "under", "mit", "apache", "cc", "by", "nc", "version", "2", "software", "é", "naïve"]
    out = [" ".join(rng.choice(filler, n)) for n in rng.integers(1, 400, 60)]
    out += [None, "", "--- !!", "under the MIT License", "Apache-License, Version 2.0", "CC BY-NC cc by nc", "UNDER the mit licenseé", "under the mit license " * 3000]
    out += [f"some code {notice(label)} more" for label in licenses.NOTICES]
    return out


@pytest.fixture(scope="module")
def got(spark):
    rows = [(i, t, "x", 0.5, 1) for i, t in enumerate(texts())] + [(None, "cc by nc", "x", 0.5, 1), (3, "all rights reserved", "x", 0.5, 1)]
    return {(r["doc_id"], i): r for i, r in enumerate(licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect())}


def test_base_places_are_those_of_a_plain_search(got):
    rows = {k[0]: r for k, r in reversed(got.items())}
    assert len(got) == len(texts()) + 2 and rows[None]["base_labels"] == "cc-by-nc"
    for i, t in enumerate(texts()):
        want, r = plain_base(t), rows[i]
        assert (r["n_words"], r["n_base"]) == (len(words(t)), len(want)), t
        assert (r["first_word"], r["last_word"]) == ((want[0][0], want[-1][0]) if want else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in want})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (not want or r["score"] == 1)


def test_notices_are_labelled_and_edited_ones_scored(spark):
    def scan(text):
        r = licenses.scan(spark.createDataFrame([(1, text, "", 0.0, 1), (2, "other text", "", 0.0, 1)], SCHEMA)).where("doc_id = 1").first()
        return set(r["labels"].split(",")) - {""}, r["score"]

    index = licenses.RareTokenIndex(licenses.templates(), 10, {})
    for label in licenses.NOTICES:
        n, first, last, base, labels, score = index.scan(licenses.words_of(f"code {notice(label)} end"))
        assert label in labels and score == pytest.approx(1)
    mit = notice("mit")
    assert "mit" in scan(mit)[0]
    inserted = scan(mit.replace("obtaining", "who is obtaining"))
    assert "mit" in inserted[0] and 0 < inserted[1] < 1
    broken = scan(mit.replace("hereby granted", "given"))
    assert "mit" not in broken[0] and 0 < broken[1] < 1
    assert scan("nothing of the kind") == (set(), 0.0)


def test_labels_and_scores_are_those_of_every_start(monkeypatch):
    """A plain search tries all starts and counts the rare tokens that stand there."""
    rng = np.random.default_rng(3)
    found = licenses.templates()
    index = licenses.RareTokenIndex(found, 50, {w: int(rng.integers(0, 50)) for t in found for w in t.words})
    vocabulary = sorted({w for t in found for w in t.words})
    for _ in range(40):
        file = list(rng.choice(vocabulary, 60)) + list(found[rng.integers(len(found))].words) + list(rng.choice(vocabulary, 20))
        at = rng.integers(len(file))
        file[at] = b"edited"
        file = [bytes(w) for w in file]
        labels, score = set(), 0.0
        for k, t in enumerate(found):
            for start in range(-len(t.words), len(file)):
                here = lambda p: file[start + p] if 0 <= start + p < len(file) else None  # noqa: E731, B023
                if sum(here(p) == w for w, ps in index.postings[k].items() for p in ps) < index.need[k]:
                    continue
                score = max(score, sum(index.idf[w] for p, w in enumerate(t.words) if here(p) == w) / sum(index.idf[w] for w in t.words))
                drift = range(-licenses.DRIFT, licenses.DRIFT + 1) if len(t.phrases) > 1 else (0,)
                if all(any(start + a + d >= 0 and tuple(file[start + a + d :][: len(p)]) == p for d in drift) for a, p in t.phrases):
                    labels.add(t.label)
        got = index.scan(file)
        assert got[4] == labels and got[5] == pytest.approx(min(1, score))


def test_no_rows(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
