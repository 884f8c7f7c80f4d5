"""Two passes of a translation reconciled sentence by sentence.

Only flagged sentences meet the completion: each gets a semantic analysis; those not equivalent get a third pass, whose
answer takes part in a consensus by mean similarity, and an adjudication where that is unclear or the difference breaks the
meaning.  The resolutions of a chunk return to it as one map, so a chunk is shuffled once and a document once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.formats import language_name
from lexweave.functions.text import longer_variant, protected_tokens, sentences, severity, stripped
from lexweave.operators.compare import SIMILARITY_THRESHOLD, flagged, indel_ratio
from lexweave.operators.completion import Asking, Completion, answer_field, answer_object, says_equivalent
from lexweave.operators.translate import context_block, system_prompt, third_pass_prompt

KEYS = ["doc_id", "chunk_index"]
#: Smallest lead of a consensus that needs no adjudication.
CONSENSUS_LEAD = 5.0
CONTEXT = 2
#: What prompts say of a chunk's document, where the chunks have it.
FACTS = ["source_lang", "is_legal", "context", "summary", "heading_context"]


def semantic_system(lang: Column) -> Column:
    return F.concat(F.lit("Decide whether two translations into "), language_name(lang), F.lit(' are equivalent. Answer with JSON: {"equivalent": bool, "severity": "low|medium|high|breaking", "explanation": text}.'))


def third_pass_system(lang: Column) -> Column:
    return F.concat(F.lit("Translate the text faithfully into "), language_name(lang), F.lit(". Return only the translation."))


def adjudication_system(lang: Column) -> Column:
    return F.concat(F.lit("Choose the best of three translations into "), language_name(lang), F.lit('. Answer with JSON: {"chosen": 1-3, "resolved_text": text, "rationale": text}.'))


def misaligned(source: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """Documents whose numbers of chunks differ: doc_id, n_source, n_one, n_two."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    both = count(source, "n_source").join(count(one, "n_one"), "doc_id", "full").join(count(two, "n_two"), "doc_id", "full")
    return both.where(~(F.col("n_source").eqNullSafe(F.col("n_one")) & F.col("n_one").eqNullSafe(F.col("n_two"))))


def consensus(rows: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Adds consensus (the variant with the highest mean similarity; ties to the first), variant (1 to 3) and unclear."""
    rows = rows.withColumns({"__ab": indel_ratio(a, b), "__ac": indel_ratio(a, c), "__bc": indel_ratio(b, c)})
    scored = F.array(*[F.struct((-(F.col(x) + F.col(y)) / 2).alias("low"), F.lit(i).alias("variant"), F.col(t).alias("text")) for i, x, y, t in ((1, "__ab", "__ac", a), (2, "__ab", "__bc", b), (3, "__ac", "__bc", c))])
    best = F.array_sort(scored)
    tokens = lambda x: F.array_sort(protected_tokens(x))
    differ = F.exists(F.slice(best, 2, 2), lambda x: tokens(x["text"]) != tokens(best[0]["text"]))
    unclear = (best[1]["low"] - best[0]["low"] < CONSENSUS_LEAD) | differ
    return rows.withColumns({"consensus": best[0]["text"], "variant": best[0]["variant"], "unclear": unclear}).drop("__ab", "__ac", "__bc")


def discrepancies(chunks: DataFrame, complete: Completion | Asking, lang: str = "en", threshold: float = SIMILARITY_THRESHOLD, glossary: Column | None = None, terms: Column | None = None) -> DataFrame:
    """A row for each flagged sentence of chunks (KEYS, source, t1, t2): its spans, analysis and resolution.

    ``glossary`` has the protected tokens, ``terms`` the glossary that prompts carry.  With the documents' FACTS beside them all prompts carry these, and the third pass asks as the first two did.  An Asking adds ``calls`` (every
    call made), ``unparsed`` (which answers were no JSON object) and keeps failures as data: a failed analysis is no equivalence,
    a failed third pass or adjudication leaves the first variant.
    """
    calls = isinstance(complete, Asking)
    call = complete.call if calls else lambda system, user: F.struct(complete(system, user).alias("answer"))
    asked = lambda c: c["attempts"].isNotNull() if calls else c.isNotNull()
    facts = [c for c in FACTS if c in chunks.columns]
    about, section = F.lit(""), F.lit("")
    if len(facts) == len(FACTS):
        about = context_block(F.col("context"), None, F.col("summary"), F.lit(""))
        about = F.concat(F.when(F.col("is_legal"), "The document is legal: its obligations, names, dates and amounts count.\n\n").otherwise(""), about)
        section = context_block(F.col("context"), terms, F.col("summary"), F.col("heading_context"))
    s1, s2, src = (sentences(F.coalesce(F.col(c), F.lit(""))) for c in ("t1", "t2", "source"))
    rows = chunks.select(*KEYS, *facts, F.coalesce("source", F.lit("")).alias("source"), s1.alias("s1"), s2.alias("s2"), src.alias("src"))
    pair = F.zip_with("s1", "s2", lambda x, y: F.struct(F.coalesce(x, F.lit("")).alias("translation_1"), F.coalesce(y, F.lit("")).alias("translation_2")))
    rows = rows.select(*KEYS, *facts, "source", "s1", "src", F.posexplode(pair).alias("sentence_index", "p"))
    i = F.col("sentence_index")
    before = F.array_join(F.slice("s1", F.greatest(i - CONTEXT, F.lit(0)) + 1, F.least(i, F.lit(CONTEXT))), " ")
    after = F.when(i + 2 <= F.size("s1"), F.array_join(F.slice("s1", F.least(i + 2, F.size("s1")), F.lit(CONTEXT)), " ")).otherwise("")
    span = F.coalesce(F.try_element_at("src", i + 1), F.lit(""))
    rows = rows.select(*KEYS, *facts, "sentence_index", "p.translation_1", "p.translation_2", span.alias("source_span"), before.alias("before"), after.alias("after"), "source")
    rows = flagged(rows, threshold, glossary)
    code = F.lit(lang)
    user = F.concat(about, F.lit("Source:\n"), "source_span", F.lit("\n\nBefore:\n"), "before", F.lit("\n\nAfter:\n"), "after", F.lit("\n\nTranslation 1:\n"), "translation_1", F.lit("\n\nTranslation 2:\n"), "translation_2")
    rows = rows.withColumn("call_1", call(semantic_system(code), user)).withColumn("analysis", F.col("call_1.answer"))
    rows = rows.withColumns({
        "equivalent": F.coalesce(says_equivalent(F.col("analysis")), F.lit(False)),
        "severity": F.coalesce(severity(answer_field(F.col("analysis"), "severity")), F.lit("medium")),
        "explanation": F.coalesce(answer_field(F.col("analysis"), "explanation"), F.when(answer_object(F.col("analysis")).isNull(), F.lit("The analysis was no JSON object.")).otherwise("")),
    })
    # Equivalent and other sentences stay in one pass; what concerns the others alone is null for the first, and null prompts are not asked.
    apart = ~F.col("equivalent")
    span = F.when(F.col("source_span") != "", F.col("source_span")).otherwise(F.col("source"))
    third = (third_pass_system(code), span)
    if len(facts) == len(FACTS):
        third = (system_prompt(code, terms), third_pass_prompt(span, F.col("source_lang"), code, F.col("is_legal"), section))
    other = rows.withColumn("call_2", F.when(apart, call(third[0], F.when(apart, third[1])))).withColumn("translation_3", stripped(F.col("call_2.answer")))
    other = other.withColumns({f"__{k}": F.when(apart, F.col(f"translation_{k}")) for k in (1, 2, 3)})
    other = consensus(other, "__1", "__2", "__3")
    ask = F.concat(about, F.lit("Source span:\n"), span, *[x for k in (1, 2, 3) for x in (F.lit(f"\n\nVariant {k}:\n"), F.col(f"translation_{k}"))])
    hard = F.col("unclear") | (F.col("severity") == "breaking")
    hard = apart & F.coalesce(hard, F.lit(True))
    other = other.withColumn("call_3", F.when(hard, call(adjudication_system(code), F.when(hard, ask)))).withColumn("judged", F.col("call_3.answer"))
    unparsed = answer_object(F.col("judged")).isNull()
    decided = F.when(~hard, F.col("consensus")).when(unparsed, F.col("translation_1")).otherwise(F.coalesce(answer_field(F.col("judged"), "resolved_text"), F.col("consensus")))
    reason = F.when(~hard, F.concat(F.lit("programmatic consensus (variant "), F.col("variant").cast("string"), F.lit(")")))
    reason = reason.when(unparsed, F.lit("Fallback to variant 1")).otherwise(F.coalesce(answer_field(F.col("judged"), "rationale"), F.lit("")))
    longer = longer_variant(F.col("translation_1"), F.col("translation_2"))
    other = other.withColumns({"resolution": F.when(apart, decided).otherwise(longer), "explanation": F.when(~apart, F.col("explanation")).otherwise(F.regexp_replace(F.concat("explanation", F.lit("; "), reason), r"^[; ]+|[; ]+$", ""))})
    no_object = lambda where, raw, what: F.when(where & answer_object(F.col(raw)).isNull(), F.lit(what))
    failed = F.array_compact(F.array(no_object(apart, "analysis", "semantic analysis"), no_object(hard, "judged", "adjudication")))
    other = other.withColumns({"calls": F.filter(F.array("call_1", "call_2", "call_3"), asked), "unparsed": failed})
    columns = [*KEYS, "sentence_index", "source_span", "translation_1", "translation_2", "translation_3", "similarity", "protected_token_mismatch", "equivalent", "severity", "explanation", "resolution", *(["calls", "unparsed"] if calls else [])]
    return other.select(*columns).withColumns({"resolved": F.lit(True), "chosen_variant": F.col("resolution")})


def resolved_chunks(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """KEYS, text: the pass with more sentences (ties: the first) with its resolutions; chunks without any keep their first pass."""
    fixes = found.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("sentence_index", "resolution"))).alias("fixes"))
    a, b = (sentences(F.coalesce(F.col(c), F.lit(""))) for c in ("t1", "t2"))
    base = F.when(F.size(a) >= F.size(b), a).otherwise(b)
    mended = F.filter(F.transform(base, lambda s, i: F.coalesce(F.try_element_at("fixes", i), s)), lambda s: F.trim(s) != "")
    whole = F.coalesce(F.nullif(F.col("t1"), F.lit("")), F.col("t2"), F.lit(""))
    return chunks.join(fixes, KEYS, "left").select(*KEYS, F.when(F.col("fixes").isNull(), whole).otherwise(F.array_join(mended, " ")).alias("text"))
