"""License scans with a positional rare-token index.

The index holds licence templates (base phrases and canonical notices with mandatory key phrases).  A first pass over the corpus
counts in how many files each licence word occurs; a template's SIGNATURE words of highest inverse document frequency, the rare
tokens, have postings (template, position).  The scan of a file then

1. looks up the rare tokens among the file's words: a posting at template position p that meets the file at word f votes for the
   template's start f - p;
2. intersects a template's postings: starts with the votes of enough of its rare tokens are proposals, all of them for a template that
   is a single phrase, so that no place of a phrase is missed, and NEED of them for a notice, which may be edited;
3. verifies each proposal: the mandatory key phrases must stand, word for word, at their relative positions, give or take DRIFT words
   for a notice of several phrases; the file gets the labels of templates whose phrases all stand.

score is the IDF-weighted share of a template's words that stand at their positions, the best over all proposals, so edited or partial
notices have scores between 0 and 1, also where a key phrase is missing.  Base phrases are templates of one key phrase; every
place of theirs is proposed, verified and counted.

Defined results: a null text is empty (no words, no labels, score 0); every row is a file of its own, so null, repeated and tied ids are
of no matter; a text of any length is scanned whole, its votes in arrays of a template at a time; words are the runs of characters
other than ASCII non-alphanumerics, after lower-casing A-Z only; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import text_of

#: Base phrases with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: The openings and conditions of public notices; the mandatory key phrases stand between bars.
NOTICES = {
    "mit": "|permission is hereby granted free of charge| to any person obtaining a copy of |this software and associated documentation files| the software to deal in the software without restriction",
    "apache-2": "|licensed under the apache license version 2| 0 the license |you may not use this file except in compliance with the license| you may obtain a copy of the license at",
    "bsd": "|redistribution and use in source and binary forms| with or without modification are permitted provided that |the following conditions are met|",
    "gpl-2": "this program is free software you can redistribute it and or modify it |under the terms of the gnu general public license| as published by the free software foundation |either version 2 of the license|",
    "gpl-3": "this program is free software you can redistribute it and or modify it |under the terms of the gnu general public license| as published by the free software foundation |either version 3 of the license|",
    "lgpl": "this library is free software you can redistribute it and or modify it |under the terms of the gnu lesser general public license| as published by the free software foundation",
    "agpl": "it |under the terms of the gnu affero general public license| as published by the free software foundation",
    "mpl-2": "this source code form is |subject to the terms of the mozilla public license v 2 0| if a copy of the mpl was not distributed with this file |you can obtain one at|",
    "cc-by": "|licensed under cc by 4 0|",
    "cc-by-sa": "|cc by sa|",
    "cc-by-nd": "|cc by nd|",
    "cc0": "to the extent possible under law |has waived all copyright and related or neighboring rights| to this work",
    "isc": "|permission to use copy modify and or distribute this software for any purpose| with or without fee is hereby granted |provided that the above copyright notice and this permission notice appear in all copies|",
    "unlicense": "|this is free and unencumbered software released into the public domain| |anyone is free to copy modify publish use compile sell or distribute this software|",
    "all-rights-reserved": "|all rights reserved|",
}

#: Other short forms, each a key phrase of its own.
PHRASES = {
    "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3", "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl", "mozilla public license": "mpl-2", "cc0 1 0 universal": "cc0",
}

#: Rare tokens of a single phrase and of a notice that have postings, and the share of a notice's that must agree on a start.
PHRASE_SIGNATURE = 2
SIGNATURE = 6
NEED = 0.5
#: Words by which a key phrase of a notice may stand off its relative position.
DRIFT = 3
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """The words, in UTF-8."""
    return text.encode("utf-8", "replace").translate(_TO_WORDS).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[int, tuple[bytes, ...]], ...]  # position in the template, words
    base: bool = False


def templates(base: dict[str, str] = BASE, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> list[Template]:
    out = [Template(label, w, ((0, w),), of is base) for of in (base, phrases) for phrase, label in of.items() for w in [tuple(words_of(phrase))]]
    for label, notice in notices.items():
        words: list[bytes] = []
        phrases = []
        for i, part in enumerate(notice.split("|")):
            if i % 2:
                phrases.append((len(words), tuple(words_of(part))))
            words += words_of(part)
        out.append(Template(label, tuple(words), tuple(phrases)))
    return out


class RareTokenIndex:
    """Postings of the templates' rare tokens; ``file_counts`` ranks the words."""

    def __init__(self, found: list[Template], files: int, file_counts: dict[bytes, int]):
        self.templates = found
        self.idf = {w: math.log((1 + files) / (1 + file_counts.get(w, 0))) + 1 for t in found for w in t.words}
        self.weights = [np.array([self.idf[w] for w in t.words]) for t in found]
        self.postings: list[dict[bytes, list[int]]] = []
        self.need: list[int] = []
        for t in found:
            # Of a word that a template repeats, every position has its posting.
            phrase = len(t.phrases) == 1 and len(t.phrases[0][1]) == len(t.words)
            rare = sorted(set(t.words), key=lambda w: (-self.idf[w], w))[: PHRASE_SIGNATURE if phrase else SIGNATURE]
            at = {w: [p for p, x in enumerate(t.words) if x == w] for w in rare}
            self.postings.append(at)
            total = sum(map(len, at.values()))
            self.need.append(total if phrase else max(2, math.ceil(NEED * total)))
        self.rare = frozenset(w for at in self.postings for w in at)

    def proposals(self, k: int, places: dict[bytes, np.ndarray]) -> list[int]:
        """Starts of template k on which enough of its rare tokens agree."""
        votes = [places[w] - p for w, at in self.postings[k].items() if w in places for p in at]
        if len(votes) < self.need[k]:
            return []
        starts, n = np.unique(np.concatenate(votes), return_counts=True)
        return starts[n >= self.need[k]].tolist()

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        """Base places, the first and last of them, base labels, all labels, score."""
        places: dict[bytes, list[int]] = defaultdict(list)
        if not self.rare.isdisjoint(words):
            for i, w in enumerate(words):
                if w in self.rare:
                    places[w].append(i)
        arrays = {w: np.array(x, dtype=np.int64) for w, x in places.items()}
        base: set[int] = set()
        base_labels, labels, score = set(), set(), 0.0
        for k, t in enumerate(self.templates if places else []):
            for start in self.proposals(k, arrays):
                drift = range(-DRIFT, DRIFT + 1) if len(t.phrases) > 1 else (0,)
                if all(any(self._stands(words, start + at + d, phrase) for d in drift) for at, phrase in t.phrases):
                    labels.add(t.label)
                    if t.base:
                        base.add(start)
                        base_labels.add(t.label)
                if score < 1:
                    low = max(0, -start)
                    own = words[start + low : max(0, start + len(t.words))]
                    same = np.array([a == b for a, b in zip(own, t.words[low:])], dtype=bool)
                    weights = self.weights[k]
                    score = max(score, min(1.0, float(weights[low : low + len(same)][same].sum() / weights.sum())))
        return len(base), min(base, default=None), max(base, default=None), base_labels, labels, score

    @staticmethod
    def _stands(words: list[bytes], at: int, phrase: tuple[bytes, ...]) -> bool:
        return at >= 0 and tuple(words[at : at + len(phrase)]) == phrase


def corpus_counts(documents: DataFrame, vocabulary: Iterable[bytes], text: str = "text") -> tuple[int, dict[bytes, int]]:
    """The number of files, and of those with each word of the vocabulary (a few hundred words: the result is that small)."""
    wanted = frozenset(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, found = 0, Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                files += 1
                found.update(wanted.intersection(words_of(x)))
        yield pa.RecordBatch.from_pydict({"word": [None, *found], "n": [files, *found.values()]}, pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    rows = documents.select(text_of(text).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in rows}
    return by.pop(None, 0), by


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(documents: DataFrame, found: list[Template] | None = None) -> DataFrame:
    """A row for each document, see RESULT; labels are distinct, sorted and joined by commas."""
    found = templates() if found is None else found
    files, counts = corpus_counts(documents, {w for t in found for w in t.words})
    index = RareTokenIndex(found, files, counts)
    schema = pa.schema([("doc_id", pa.int64())] + [(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")] + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                n, first, last, base, labels, score = index.scan(words)
                rows.append((doc, len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, RESULT)
