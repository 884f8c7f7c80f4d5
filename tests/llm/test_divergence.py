"""The audit against whole-number arithmetic in plain Python."""

import random
import re
from collections import Counter, defaultdict

from lexweave.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n string, value string"


def plain(rows, least, top):
    counts, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        langs[lang].add(source)
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, k in df[lang].items() if k >= least]
        v = len(kept)

        def share(count, v=v, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * v) for t in kept}

        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        own = {s: share(counts[lang, s]) for s in sources}
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(far(own[s][t], own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-far(own[s][t], whole[t]), t.encode(), t) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            out |= {(lang, s, "pair", o, -d, i) for i, (d, _, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t, -d, i) for i, (d, _, t) in enumerate(sorted(terms)[:top], 1)}
    return out


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i % 7, *r, "a", "b", "c") for i, r in enumerate(rows)], SCHEMA)
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_audit_of_random_rows_with_nulls_and_ties(spark):
    rng = random.Random(1)
    words = ["a", "B", "b", "ÄÖ", "äö", "été", "x1y", "𝒳z", "don't", "_", "12", "zeta"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "ß", None, ""])) for _ in range(150)]
    rows += [(None, "en", "s1"), ("", "fr", "only"), (None, "it", "a"), ("", "it", "b"), ("word " * 20000, "en", "s2")] + [rows[0]] * 5
    for least, top in ((1, 10), (2, 3), (1000, 10)):
        assert found(spark, rows, least=least, top=top) == plain(rows, least, top)


def test_counts_beyond_64_bits(spark):
    row = spark.range(1).select(divergence.probability((10**13 - 2 + divergence.F.col("id")), divergence.F.lit(3 * 10**13), divergence.F.lit(10**6)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * 10**13 // (3 * 10**13 + 2 * 10**6)


def test_counts_around_the_last_that_stays_in_64_bits(spark):
    counts = [divergence.MOST + i for i in range(-4, 5)]
    rows = spark.createDataFrame([(c,) for c in counts], "c long").select("c", divergence.probability(divergence.F.col("c"), divergence.F.lit(10**10), divergence.F.lit(3)).alias("p")).collect()
    assert {r["c"]: r["p"] for r in rows} == {c: 1 + 10**9 * (c + 2) // (10**10 + 6) for c in counts}


def test_only_kept_terms_go_on_with_their_counts_in_source_and_language(spark):
    docs = spark.createDataFrame([(1, "a A b", "en", "s"), (2, "a c c", "en", "s"), (3, "b, a", "en", None), (4, "c", "de", "s"), (5, None, "en", "s")], "doc_id long, text string, lang string, source string")
    found, kept = divergence.term_counts(docs, 2)
    assert sorted(tuple(r) for r in found.select("lang", "source", "term", "n", "lang_n").collect()) == [("en", "", "a", 1, 4), ("en", "", "b", 1, 2), ("en", "s", "a", 3, 4), ("en", "s", "b", 1, 2)]
    assert sorted(tuple(r) for r in kept.collect()) == [("en", "a", 4), ("en", "b", 2)]


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
