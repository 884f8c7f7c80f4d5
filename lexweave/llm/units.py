"""Texts as sequences of units that tokenizers never join, and the tables of the byte-level vocabulary file.

A cut lies before a space that follows a character which is no white space: pre-tokenizers start a word there, and no piece of a
vocabulary with word starts reaches over it.  So what a tokenizer does to a unit does not depend on the others, and a block of texts
needs each distinct unit once.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np

_JOINT = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
_ASCII_JOINTS = [chr(i) + " " for i in (*range(9, 14), *range(28, 33))]


def parts(text: str) -> list[str]:
    """The units without the space before each (the first has none before it)."""
    joint = any(j in text for j in _ASCII_JOINTS) if text.isascii() else _JOINT.search(text)
    return _CUT.split(text) if joint or text[:1] == " " else text.split(" ")


def numbering() -> defaultdict:
    """Gives each key that it is asked for the next number."""
    return defaultdict(count().__next__)


@lru_cache(maxsize=1)
def byte_of() -> dict[str, int]:
    """The byte that each visible character of a byte-level vocabulary stands for."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}


class ByteVocabulary:
    """A byte-level BPE file: ``tokens`` (bytes by id), ``merges`` (left, right and made ids by rank), ``bytes`` (id by byte), ``added`` (id by text)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            kept = json.load(f)
        split = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        plain = all(not a[k] for a in kept["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if kept["normalizer"] is not None or kept["pre_tokenizer"] != split or kept["model"]["ignore_merges"] or not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        vocabulary, byte = kept["model"]["vocab"], byte_of()
        self.added = {a["content"]: a["id"] for a in kept["added_tokens"]}
        ids = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.added.items()}
        self.tokens = [bytes(byte[c] for c in ids[i]) if i in ids else b"" for i in range(max(ids) + 1)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in kept["model"]["merges"]]
        self.merges = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], dtype=np.int64).reshape(-1, 3)
        self.bytes = np.array([vocabulary[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])], dtype=np.int64)


@lru_cache(maxsize=1)
def byte_vocabulary(path: str) -> ByteVocabulary:
    """One per Python worker, however many tasks it runs."""
    return ByteVocabulary(path)
