"""Language and legal classification: rules as column expressions, with a completion where they are unsure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.text import legal_hits, let, stripped
from lexweave.operators.chunking import language_sample
from lexweave.operators.completion import Completion, language_answer

# Thresholds, confidences and sample sizes.
SHORT = 40
CONFIDENT = 0.85
AI_CONFIDENCE = 0.5
AI_SAMPLE = 4000
LEGAL_HITS = 3
LEGAL_OBJECT = r"\{[^{}]*\}"

#: Frequent function words by language: the profile of a language that is written in Latin letters.
WORDS = {
    "de": ["der", "die", "das", "und", "nicht", "ist", "von", "zu", "mit", "auf", "für", "ein", "eine", "sich", "wir"],
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "was", "with", "on", "this", "are", "by", "it"],
    "es": ["el", "los", "las", "y", "que", "en", "por", "con", "para", "del", "una", "un", "se", "al", "como"],
    "fr": ["le", "les", "et", "est", "dans", "pour", "qui", "avec", "sur", "des", "une", "du", "au", "par", "ou"],
    "it": ["il", "gli", "che", "di", "non", "per", "della", "sono", "con", "una", "nel", "anche", "è", "alla", "dei"],
    "nl": ["het", "een", "van", "niet", "zijn", "met", "voor", "op", "dat", "ook", "aan", "naar", "bij", "wordt", "deze"],
    "pl": ["nie", "się", "jest", "że", "na", "do", "jak", "przez", "oraz", "dla", "są", "ale", "od", "tak", "tego"],
    "pt": ["os", "não", "uma", "para", "com", "por", "mais", "dos", "como", "mas", "foi", "ao", "das", "seu", "ele"],
    "sv": ["och", "att", "det", "som", "en", "är", "av", "för", "inte", "den", "till", "med", "har", "ett", "om"],
    "tr": ["ve", "bir", "bu", "için", "ile", "da", "de", "çok", "olarak", "daha", "gibi", "olan", "ne", "kadar", "ama"],
}
#: Letters that decide the language by themselves; Japanese is asked before Chinese, as it uses both.
SCRIPTS = {"ja": r"[\x{3040}-\x{30FF}]", "zh": r"[\x{4E00}-\x{9FFF}]", "ko": r"[\x{AC00}-\x{D7AF}]", "ru": r"[\x{0400}-\x{04FF}]", "ar": r"[\x{0600}-\x{06FF}]", "he": r"[\x{0590}-\x{05FF}]"}
SCRIPT_SHARE = 0.3


def scores(sample: Column) -> Column:
    """Array of (n, lang): how many of a sample's words are a language's function words, the most first; ties in order of codes."""

    def count(words: Column) -> Column:
        among = lambda own: lambda w: w.isin(own)
        return F.array_sort(F.array(*[F.struct((-F.size(F.filter(words, among(own)))).alias("n"), F.lit(lang).alias("lang")) for lang, own in sorted(WORDS.items())]))

    found = let(F.split(F.lower(sample), r"[^\p{L}]+"), count)
    return F.transform(found, lambda x: F.struct((-x["n"]).alias("n"), x["lang"].alias("lang")))


def script_of(sample: Column) -> Column:
    """(lang, confidence) by the script of a sample's letters, its share the confidence; null where no script decides."""
    # Runs are taken away and lengths compared, as a list of all single letters is dear.
    count = lambda pattern: F.length(sample) - F.length(F.regexp_replace(sample, f"{pattern}+", ""))
    letters = F.greatest(count(r"\p{L}"), F.lit(1))
    shares = F.array(*[F.struct(F.lit(lang).alias("lang"), (count(pattern) / letters).alias("share")) for lang, pattern in SCRIPTS.items()])
    answer = lambda x: F.struct(x["lang"].alias("lang"), F.least(F.lit(1.0), x["share"]).cast("double").alias("confidence"))
    found = let(F.filter(shares, lambda x: x["share"] >= SCRIPT_SHARE), lambda x: F.when(F.size(x) > 0, answer(x[0])))
    return F.when(F.regexp_like(sample, F.lit(f"[{''.join(p[1:-1] for p in SCRIPTS.values())}]")), found)


def rule(sample: Column) -> Column:
    """(lang, confidence) by script or by function words; null where neither says anything.

    A script's confidence is its share of the letters; that of words is the share of the best language in all function words found.
    """
    answer = lambda lang, confidence: F.struct(lang.alias("lang"), confidence.cast("double").alias("confidence"))
    def best(ranked: Column) -> Column:
        total = F.aggregate(ranked, F.lit(0), lambda s, x: s + x["n"])
        return F.when(total > 0, answer(ranked[0]["lang"], ranked[0]["n"] / total))

    return F.coalesce(script_of(sample), let(scores(sample), best))


def language_prompt(text: Column, threshold: float = CONFIDENT, known: Column | None = None) -> tuple[Column, Column]:
    """What asks for a text's language; the user prompt is null where the rule is sure."""
    system = F.lit("Name the main language of the text. Answer with its two-letter ISO 639-1 code only.")

    def unsure(s: Column) -> Column:
        found = known if known is not None else F.when(F.length(stripped(s)) >= SHORT, rule(s))
        return F.when(F.coalesce(found["confidence"] < threshold, F.lit(True)), F.left(s, F.lit(AI_SAMPLE)))

    return system, let(language_sample(text), unsure)


def legal_prompt(text: Column) -> tuple[Column, Column]:
    """What asks whether a text is legal; the user prompt is null where its hits decide."""
    system = F.lit('Is this document mainly a legal contract, agreement or similar instrument? Answer with JSON: {"is_legal": bool, "confidence": number}.')
    return system, F.when(legal_hits(text).between(1, LEGAL_HITS - 1), F.left(text, F.lit(AI_SAMPLE)))


def language(text: Column, complete: Completion | None = None, threshold: float = CONFIDENT, known: Column | None = None) -> Column:
    """(lang, confidence, used_ai) of a text, from its first, middle and last chunk.

    ``known`` is a (lang, confidence) found before, as by ``ngrams.detect``, in place of the word lists.

    Short samples and those without any sign go to the completion (confidence 0.5), or are unknown (0) without one; an unsure rule
    asks the completion but keeps its own confidence, and without one its own language.
    """
    answer = lambda lang, confidence, ai: F.struct(lang.alias("lang"), confidence.cast("double").alias("confidence"), F.lit(ai).alias("used_ai"))
    sample = language_sample(text)
    # A client's answer is no part of a lambda, so the prompt is made beside it.
    asked = None if complete is None else language_answer(complete(*language_prompt(text, threshold, known)))
    found = known if known is not None else let(sample, lambda s: F.when(F.length(stripped(s)) >= SHORT, rule(s)))
    if asked is None:
        return let(found, lambda f: F.when(f.isNull(), answer(F.lit("unknown"), F.lit(0.0), False)).otherwise(answer(f["lang"], f["confidence"], False)))
    return let(
        F.struct(found.alias("found"), asked.alias("asked")),
        lambda x: F.when(x["found"].isNull(), answer(x["asked"], F.lit(AI_CONFIDENCE), True))
        .when(x["found"]["confidence"] >= threshold, answer(x["found"]["lang"], x["found"]["confidence"], False))
        .otherwise(answer(x["asked"], x["found"]["confidence"], True)),
    )


def source_mismatch(override: Column, detected: Column) -> Column:
    """Whether a given source language differs from a detected one."""
    return override.isNotNull() & (detected != "unknown") & (detected != override)


def legal(text: Column, complete: Completion | None = None) -> Column:
    """(is_legal, used_ai, parse_failed): three hits are legal, none is not; one or two are confirmed, or legal from two on."""
    answer = lambda is_legal, ai, failed: F.struct(is_legal.alias("is_legal"), F.lit(ai).alias("used_ai"), failed.alias("parse_failed"))
    no = F.lit(False)
    if complete is None:
        return let(legal_hits(text), lambda hits: answer(hits >= 2, False, no))
    raw = complete(*legal_prompt(text))
    found = F.try_parse_json(F.nullif(F.regexp_extract(raw, LEGAL_OBJECT, 0), F.lit("")))
    said = F.coalesce(~F.try_variant_get(found, "$.is_legal", "string").isin("", "false", "0", "0.0", "[]", "{}"), no)

    def decide(x: Column) -> Column:
        settled = F.when(x["hits"] >= LEGAL_HITS, answer(F.lit(True), False, no)).when(x["hits"] == 0, answer(no, False, no))
        return settled.when(~x["parsed"], answer(x["hits"] >= 2, True, F.lit(True))).otherwise(answer(x["said"], True, no))

    return let(F.struct(legal_hits(text).alias("hits"), found.isNotNull().alias("parsed"), said.alias("said")), decide)
