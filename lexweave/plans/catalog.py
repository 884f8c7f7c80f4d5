"""Named queries over the supplied tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import formats as R
from lexweave.functions import rules as U
from lexweave.functions import text as T
from lexweave.functions.tables import register as register_tables
from lexweave.operators import detect as D
from lexweave.operators import glossary as G
from lexweave.operators import jobs as J
from lexweave.operators import ngrams as NG
from lexweave.operators import runs as N
from lexweave.operators.chunking import chunk, document_summary, language_sample, reassemble
from lexweave.operators.compare import flagged, sentence_pairs
from lexweave.operators import translate as TR
from lexweave.operators.completion import counted, mock
from lexweave.operators.reconcile import discrepancies, resolved_chunks
from lexweave.operators.translate import LEGAL_NOTE
from lexweave.operators.translate import pending as pending_rows
from lexweave.operators.translate import translate_documents
from lexweave.plans import evaluation as E
from lexweave.sources import pages as P
from lexweave.sources.tables import ENTITIES, html_text, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


_HITS = " + ".join(rf"CAST(regexp_matches(text, '{p}') AS INTEGER)" for p in T.LEGAL_PATTERNS)
_STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_TOKENS = rf"CAST(ceil(length({_STRIP}) / 4.0) AS BIGINT)"
_SENTENCES = rf"list_filter(string_split(regexp_replace({_STRIP}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


@query(f"""SELECT lang, count(*) AS n_docs, CAST(sum(hits) AS BIGINT) AS legal_hits, CAST(sum(CAST(hits > 0 AS INTEGER)) AS BIGINT) AS legal_docs, CAST(sum(tokens) AS BIGINT) AS tokens
FROM (SELECT lang, {_HITS} AS hits, {_TOKENS} AS tokens FROM documents) GROUP BY lang""")
def triage_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    hits = T.legal_hits(F.col("text"))
    rows = _docs(spark, sf).select("lang", hits.alias("hits"), T.token_estimate(F.col("text")).alias("tokens"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("hits").alias("legal_hits"), F.sum((F.col("hits") > 0).cast("int")).alias("legal_docs"), F.sum("tokens").alias("tokens"))


@query(f"SELECT doc_id, sha256({_STRIP}) AS source_hash FROM documents")
def normalize_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.source_hash(F.col("text")).alias("source_hash"))


@query(f"SELECT sha256({_STRIP}) AS source_hash, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_sources(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_hash(spark, sf).groupBy("source_hash").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


@query(f"SELECT doc_id, hits, CASE WHEN hits >= 3 THEN 'legal' WHEN hits = 0 THEN 'other' ELSE 'ambiguous' END AS legal_class FROM (SELECT doc_id, {_HITS} AS hits FROM documents)")
def legal_class(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.legal_hits(F.col("text")).alias("hits")).withColumn("legal_class", T.legal_class(F.col("hits")))


@query(f"SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS sentence_index, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def sentence_explode(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_index", "sentence"))


@query(f"SELECT lang, CAST(sum(len({_SENTENCES})) AS BIGINT) AS n_sentences, CAST(max(len({_SENTENCES})) AS BIGINT) AS most FROM documents GROUP BY lang")
def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size(T.sentences(F.col("text"))).cast("long")
    return _docs(spark, sf).select("lang", n.alias("n")).groupBy("lang").agg(F.sum("n").alias("n_sentences"), F.max("n").alias("most"))


@query(r"""WITH s AS (SELECT doc_id, CAST(i AS INTEGER) AS sentence_index, s[i + 1] AS sentence FROM (SELECT doc_id, """ + _SENTENCES + r""" AS s FROM documents), unnest(range(len(s))) AS u(i))
SELECT doc_id, sentence_index, sentence, concat_ws(' ', lag(sentence, 2) OVER w, lag(sentence) OVER w) AS before, concat_ws(' ', lead(sentence) OVER w, lead(sentence, 2) OVER w) AS after
FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY sentence_index)""")
def neighbour_context(spark: SparkSession, sf: str) -> DataFrame:
    """Two sentences on either side; they lie in the sentence's own array, so nothing is shuffled."""
    rows = _docs(spark, sf).select("doc_id", T.sentences(F.col("text")).alias("all"))
    near = lambda low, n: F.array_join(F.slice("all", low, n), " ")
    i = F.col("sentence_index")
    rows = rows.select("doc_id", "all", F.posexplode("all").alias("sentence_index", "sentence"))
    before = F.when(i > 0, near(F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)))).otherwise("")
    after = F.when(i + 1 < F.size("all"), near(F.least(i + 2, F.size("all")), F.lit(2))).otherwise("")
    return rows.select("doc_id", "sentence_index", "sentence", before.alias("before"), after.alias("after"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*\S+', '<redacted>', 'g'), '(?i)Bearer\s+\S+', '<redacted>', 'g') AS text FROM documents""")
def redact_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.redact_secrets(F.col("text")).alias("text"))


@query(r"""SELECT page_id, CASE WHEN length(m) > 500 THEN substr(m, 1, 500) || '...' ELSE m END AS detail FROM (
SELECT page_id, regexp_replace(url, '(?:/[A-Za-z0-9_.@+-]+){2,}|(?:[A-Za-z]:\\)[^\s]+', '<path>', 'g') AS m FROM pages)""")
def mask_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.mask_paths(F.col("url")).alias("detail"))


@query(f"""SELECT p.selector, t.tokens, round_even((t.tokens * p.rate_in + t.tokens * p.rate_out) / 1000000, 6) AS cost
FROM (SELECT CAST(sum({_TOKENS}) AS BIGINT) AS tokens FROM documents) AS t, (VALUES {', '.join(f"('{s}', {i}::DOUBLE, {o}::DOUBLE)" for s, (i, o) in R.PRICES.items())}) AS p(selector, rate_in, rate_out)""")
def token_cost(spark: SparkSession, sf: str) -> DataFrame:
    """What the corpus would cost if translations were as long as their sources."""
    total = _docs(spark, sf).agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"))
    rows = total.select(F.explode(F.array(*map(F.lit, R.PRICES))).alias("selector"), "tokens")
    return rows.withColumn("cost", R.cost(F.col("selector"), F.col("tokens"), F.col("tokens")))


_PROMPT = f"""'Source language: ' || lang || '. Target language: English (en).' || CASE WHEN {_HITS} >= 2 THEN '{LEGAL_NOTE}' ELSE '' END || chr(10)
|| 'Document summary:' || chr(10) || regexp_replace(substr({_STRIP}, 1, 250), '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || 'Chunk 1' || chr(10) || chr(10) || {_STRIP}"""


@query(f"SELECT doc_id, '[EN] ' || {_PROMPT} || chr(10) AS text FROM documents WHERE {_STRIP} <> ''")
def mock_translate_quick(spark: SparkSession, sf: str) -> DataFrame:
    """Documents chunked, translated by the mock, which repeats its prompt, and joined again; the documents are one paragraph, so one chunk."""
    rows = _docs(spark, sf).select("doc_id", "text", F.col("lang").alias("source_lang"), F.lit("en").alias("target_lang"), D.legal(F.col("text"))["is_legal"].alias("is_legal"), F.lit("").alias("context"))
    return translate_documents(rows, mock(), "doc_id", "mock")


@query("SELECT doc_id, '# ' || source || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text AS markdown FROM documents")
def export_compose(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.cover_and_body(F.concat(F.lit("# "), "source"), F.col("text"), F.lit("md")).alias("markdown"))


def _html_sql() -> str:
    """The steps of html_text in SQL."""
    h = "html"
    step = lambda pattern, by: f"regexp_replace({h}, '{pattern}', {by}, 'g')"
    h = step(r"(?is)<!--.*?-->|<(script|style|head|template)\b[^>]*>.*?</(script|style|head|template)>", "''")
    for level in range(1, 7):
        h = step(rf"(?i)<h{level}\b[^>]*>", f"chr(10) || chr(10) || '{'#' * level} '")
    h = step(r'(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>', r"'[\2](\1)'")
    h = step(r"(?i)</?(b|strong)\b[^>]*>", "'**'")
    h = step(r"(?i)</?(i|em)\b[^>]*>", "'*'")
    h = step(r"(?i)<li\b[^>]*>", "chr(10) || '- '")
    h = step(r"(?i)<br\s*/?>", "chr(10)")
    h = step(r"(?i)</?(p|div|ul|ol|h[1-6]|article|section|nav|footer|table|tr)\b[^>]*>", "chr(10) || chr(10)")
    h = step(r"(?s)<[^>]*>", "''")
    for entity, char in ENTITIES.items():
        h = f"replace({h}, '{entity}', chr({ord(char)}))"
    h = step(r"\n{3,}", "chr(10) || chr(10)")
    return step(r"^\s+|\s+$", "''")


@query(f"SELECT page_id, {_html_sql()} AS markdown FROM pages")
def html_to_md(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html_text(F.col("html")).alias("markdown"))


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.concat(F.lit("# "), "role", F.lit("\n\n"), "text")
    turns = F.array_sort(F.collect_list(F.struct("turn", turn.alias("text"))))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\n\n").alias("text"))


def _chunk_sql(most: int, overlap: bool) -> str:
    """Chunks of the conversations: a turn is a heading and a paragraph, and a heading closes the chunk before it."""
    strip = r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g')"
    alone = "h || chr(10) || chr(10) || x" if overlap else "x"
    return f"""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS INTEGER) AS chunk_index, text, h AS heading_context FROM (
SELECT conv_id, turn, h, CAST(unnest(range(len(c))) AS INTEGER) AS k, unnest(c) AS text FROM (
SELECT conv_id, turn, h, CASE WHEN x = '' THEN [h] WHEN length(h) + 2 + length(x) <= {most} THEN [h || chr(10) || chr(10) || x] ELSE [h, {alone}] END AS c
FROM (SELECT conv_id, turn, '# ' || role AS h, {strip} AS x FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)))"""


@query(_chunk_sql(2500, True))
def chunk_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return chunk(_conversations(spark, sf), "conv_id", "text")


@query(_chunk_sql(2500, True))
def sql_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The same chunks by the table function that SQL can call."""
    register_tables(spark)
    rows = spark.sql("SELECT * FROM chunks(TABLE(SELECT conv_id AS key, text FROM {docs}) PARTITION BY key)", docs=_conversations(spark, sf))
    return rows.select(F.col("key").cast("long").alias("conv_id"), "chunk_index", "text", "heading_context")


@query(f"SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) || chr(10) AS text FROM ({_chunk_sql(2500, True)}) GROUP BY conv_id")
def reassembled_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return reassemble(chunk_conversations(spark, sf), "conv_id")


@query()
def chunk_pages(spark: SparkSession, sf: str) -> DataFrame:
    return chunk(html_to_md(spark, sf), "page_id", "markdown")


@query()
def compare_passes(spark: SparkSession, sf: str) -> DataFrame:
    """The first pass against one that a fixed rewriting makes."""
    rows = _docs(spark, sf).select("doc_id", F.col("text").alias("one"), F.regexp_replace("text", r"\b(the|der|la|el)\b", "a").alias("two"))
    return flagged(sentence_pairs(rows, ["doc_id"], "one", "two"))


@query("SELECT lang, any_value(CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE lang END) AS language, count(*) AS n FROM documents GROUP BY lang")
def language_names(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).groupBy("lang").agg(F.first(R.language_name(F.col("lang"))).alias("language"), F.count("*").alias("n"))


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    """The conversations' chunks as a client answers them that fails for about an eighth, by the chunk's digest."""
    rows = _conversations(spark, sf).withColumns({"source_lang": F.lit("de"), "target_lang": F.lit("en"), "is_legal": F.lit(False), "context": F.lit("")})
    own = lambda user: F.regexp_extract(user, r"(?s)Chunk \d+\n\n(.*)$", 1)
    fails = lambda system, user: F.when(F.substring(F.sha2(own(user), 256), 1, 1).isin("0", "1"), "ConnectionError: HTTP 503")
    asking = counted(lambda system, user: F.concat(F.lit("[EN] "), own(user)), fails)
    return TR.attempt_chunks(TR.document_chunks(rows, "conv_id", USED), asking, TR.memo_of(spark, "conv_id long"), ["conv_id"])


USED = "openai:gpt-4o"
_FAILS = "substr(sha256(text), 1, 1) IN ('0', '1')"


@query(f"""SELECT conv_id, CASE WHEN bool_or({_FAILS}) THEN 'failed' ELSE 'completed' END AS status, count(*) AS chunks, count(*) FILTER ({_FAILS}) AS failed, min(chunk_index) FILTER ({_FAILS}) AS first_failed,
CASE WHEN bool_or({_FAILS}) THEN 'ConnectionError: HTTP 503' ELSE string_agg('[EN] ' || text, chr(10) || chr(10) ORDER BY chunk_index) || chr(10) END AS error_or_text FROM ({_chunk_sql(2500, True)}) GROUP BY conv_id""")
def partial_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations translated by a client that fails at times: the failure is its document's alone."""
    rows = TR.document_results(_attempts(spark, sf), ["conv_id"])
    return rows.select("conv_id", "status", "chunks", "failed", "first_failed", F.coalesce("error", "text").alias("error_or_text"))


_SYSTEM = "You are a professional translator of documents. Translate the text faithfully into English (en). Keep the Markdown structure: headings, lists, numbering and paragraphs. In legal text keep modal verbs, names of parties, dates and amounts exactly. Return only the translated Markdown."
_BEGIN = r"regexp_replace(substr(CASE WHEN len(c) = 1 THEN substr(c[1], 1, 250) ELSE substr(c[1], 1, 250) || chr(10) || '...' || chr(10) || substr(c[len(c)], 1, 250) END, 1, 500), '^\s+|\s+$', '', 'g')"
_QUARTER = lambda t: f"CAST(ceil(length({t}) / 4.0) AS BIGINT)"


@query(f"""WITH s AS (SELECT conv_id, {_BEGIN} AS summary FROM (SELECT conv_id, list(text ORDER BY chunk_index) AS c FROM ({_chunk_sql(2000, False)}) GROUP BY conv_id)),
u AS (SELECT conv_id, {_QUARTER(f"'{_SYSTEM}'")} + {_QUARTER("'Source language: de. Target language: English (en).' || chr(10) || CASE WHEN summary <> '' THEN 'Document summary:' || chr(10) || summary || chr(10) ELSE '' END || 'Section context: ' || heading_context || chr(10) || chr(10) || 'Chunk ' || (chunk_index + 1) || chr(10) || chr(10) || text")} AS tokens_in,
{_QUARTER("'[EN] ' || text")} AS tokens_out, NOT {_FAILS} AS ok FROM ({_chunk_sql(2500, True)}) JOIN s USING (conv_id)),
j AS (SELECT conv_id, count(*) FILTER (ok) AS n_calls, coalesce(CAST(sum(tokens_in) FILTER (ok) AS BIGINT), 0) AS tokens_in, coalesce(CAST(sum(tokens_out) FILTER (ok) AS BIGINT), 0) AS tokens_out FROM u GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS job_id, '{USED}' AS selector, n_calls, tokens_in, tokens_out, round_even(tokens_in * {R.PRICES[USED][0]}::DOUBLE + tokens_out * {R.PRICES[USED][1]}::DOUBLE, 0) / 1000000 AS cost FROM j WHERE n_calls > 0""")
def usage_by_job(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, tokens and cost of each conversation's translation; a failed call costs nothing."""
    return J.usage_cost(TR.calls_of(_attempts(spark, sf), F.col("conv_id").cast("string"), USED))


_ISSUES = """(SELECT 'j' || (doc_id % 97) AS job_id, doc_id AS pos, CASE doc_id % 5 WHEN 0 THEN 'warn' WHEN 1 THEN 'info' ELSE 'debug' END AS severity, 'm' || doc_id AS message FROM documents)"""


def _issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issues that a rule makes of the documents' ids."""
    d = F.col("doc_id")
    job = F.concat(F.lit("j"), (d % 97).cast("string"))
    return _docs(spark, sf).select(job.alias("job_id"), d.alias("pos"), F.when(d % 5 == 0, "warn").when(d % 5 == 1, "info").otherwise("debug").alias("severity"), F.concat(F.lit("m"), d.cast("string")).alias("message"))


_JOBS = f"""(SELECT job_id, count(severity) AS n_issues, CAST(sum(CAST(severity = 'warn' AS INTEGER)) AS BIGINT) AS n_warnings,
CASE WHEN job_id = 'j7' THEN 'failed' WHEN bool_or(severity = 'warn') THEN 'completed_with_warnings' ELSE 'completed' END AS status FROM {_ISSUES} GROUP BY job_id)"""


@query(f"SELECT * FROM {_JOBS}")
def issue_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return J.job_status(_issues(spark, sf), F.col("job_id") == "j7")


@query(f"""SELECT *, CASE WHEN failed > 0 THEN 'failed' WHEN with_warnings > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status, CASE WHEN failed > 0 THEN 2 WHEN with_warnings > 0 THEN 3 ELSE 0 END AS exit_code
FROM (SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'completed_with_warnings') AS with_warnings, count(*) FILTER (status = 'failed') AS failed FROM {_JOBS})""")
def batch_status(spark: SparkSession, sf: str) -> DataFrame:
    return J.batch_status(issue_rollup(spark, sf))


@query(f"SELECT job_id, string_agg(message, '|' ORDER BY pos) AS warnings FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY pos) AS nth FROM {_ISSUES} WHERE severity = 'warn') WHERE nth <= 3 GROUP BY job_id")
def top_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return J.top_warnings(_issues(spark, sf)).select("job_id", F.array_join("warnings", "|").alias("warnings"))


@query("""SELECT source, string_agg('e' || doc_id, '|' ORDER BY doc_id) FILTER (nth <= 4) || CASE WHEN max(nth) > 4 THEN '|+ ' || (max(nth) - 4) || ' more item(s) listed in the job metadata.' ELSE '' END AS items
FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents WHERE doc_id % 3 = 0) GROUP BY source""")
def review_items(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    rows = _docs(spark, sf).select("source", d.alias("pos"), F.when(d % 3 == 0, "breaking").otherwise("low").alias("severity"), F.lit(False).alias("resolved"), F.concat(F.lit("e"), d.cast("string")).alias("explanation"))
    return J.review_items(rows, "source").select("source", F.array_join("items", "|").alias("items"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("chunk_index"), F.sha2("text", 256).alias("source_hash"), F.lit("mock").alias("llm"), F.lit(1).alias("pass_num"), "text")


def _memo(spark: SparkSession, sf: str) -> DataFrame:
    """Turns done before; some with an older text, another model or in another pass, so they are not done."""
    place = (F.col("conv_id") + F.col("chunk_index")) % 16
    rows = _turns(spark, sf).withColumn("source_hash", F.when(place == 0, "old").otherwise(F.col("source_hash")))
    return rows.withColumns({"llm": F.when(place == 4, "other").otherwise(F.col("llm")), "pass_num": F.when(place == 8, 2).otherwise(F.col("pass_num"))}).where(place != 12)


@query("""SELECT c.conv_id, c.turn AS chunk_index FROM conversations c LEFT JOIN (SELECT conv_id, min(turn) AS gap FROM conversations WHERE (conv_id + turn) % 4 = 0 GROUP BY conv_id) g USING (conv_id) WHERE gap IS NULL OR turn < gap""")
def resume_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return J.completed_prefix(_turns(spark, sf), _memo(spark, sf), ["conv_id"]).select("conv_id", "chunk_index")


@query("SELECT conv_id, turn AS chunk_index FROM conversations WHERE (conv_id + turn) % 4 = 0")
def pending_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return pending_rows(_turns(spark, sf), _memo(spark, sf), ["conv_id"]).select("conv_id", "chunk_index")


@query(r"""SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN contains(text, chr(65533)) THEN 'ENCODING_LOSS' END, CASE WHEN length(text) = 0 THEN 'EMPTY_EXTRACTION' END,
CASE WHEN length(text) / (1 + doc_id % 3) < 50 THEN 'LOW_TEXT_DENSITY' END, CASE WHEN octet_length(encode(text)) > 20000000 THEN 'LARGE_INPUT_FILE' END], lambda x: x IS NOT NULL)) AS code FROM documents) GROUP BY code""")
def alert_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts as if a document had one to three pages by its id."""
    t = F.col("text")
    codes = J.alerts(t, 1 + F.col("doc_id") % 3, F.octet_length(t), F.contains(t, F.lit("�")))
    return _docs(spark, sf).select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, round(100.0 * count(*) FILTER (ok) / count(*), 1)::DOUBLE AS pass_rate
FROM (SELECT item_id % 9 <> 0 AND length(text) >= 120 AS ok FROM benchmark)""")
def qa_summary(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").withColumn("backend", F.lit("text"))
    rows = b.select(F.col("item_id").alias("file"), "backend", F.length("text").alias("chars"), F.when(F.col("item_id") % 9 == 0, "broken").alias("error"), F.lit("").alias("hash"))
    golden = b.select(F.col("item_id").alias("file"), "backend", F.lit(120).alias("min_chars"), F.lit(None).cast("string").alias("golden_hash"))
    return J.qa_summary(J.qa_rows(rows, golden))


def _two_passes(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, sf).select("doc_id", F.lit(0).alias("chunk_index"), text.alias("source"), text.alias("t1"), F.regexp_replace("text", r"\b(the|der|la|el)\b", "a").alias("t2"))


@query()
def reconcile_thorough(spark: SparkSession, sf: str) -> DataFrame:
    """Reconciled documents of two passes under the mock completion."""
    chunks = _two_passes(spark, sf)
    return reassemble(resolved_chunks(chunks, discrepancies(chunks, mock())), "doc_id")


@query(f"""SELECT conv_id, substr(CASE WHEN len(c) = 1 THEN substr(c[1], 1, 250) ELSE substr(c[1], 1, 250) || chr(10) || '...' || chr(10) || substr(c[len(c)], 1, 250) END, 1, 500) AS summary,
substr(c[1] || CASE WHEN len(c) > 2 THEN chr(10) || chr(10) || c[len(c) // 2 + 1] ELSE '' END || CASE WHEN len(c) > 1 THEN chr(10) || chr(10) || c[len(c)] ELSE '' END, 1, 8000) AS sample
FROM (SELECT conv_id, list(text ORDER BY chunk_index) AS c FROM ({_chunk_sql(2000, False)}) GROUP BY conv_id)""")
def document_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _conversations(spark, sf).select("conv_id", document_summary(F.col("text")).alias("summary"), language_sample(F.col("text")).alias("sample"))


@query(f"SELECT doc_id, CAST({_HITS} AS INTEGER) AS hits, {_HITS} >= 2 AS is_legal FROM documents")
def legal_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits, and the classification where no completion confirms one or two of them."""
    return _docs(spark, sf).select("doc_id", T.legal_hits(F.col("text")).cast("int").alias("hits"), D.legal(F.col("text"))["is_legal"].alias("is_legal"))


@query(rf"""SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '{T.PROTECTED}'), regexp_extract_all(text, '{T.PROPER_NOUNS}')))), '|') AS tokens
FROM (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS text FROM benchmark)""")
def protected_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """In plain letters, as engines differ in what they take for the end of a word with accents."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.protected_tokens(plain), "|").alias("tokens"))


@query("SELECT b.item_id, CASE WHEN length(b.text) >= length(c.text) THEN b.text ELSE c.text END AS pick FROM benchmark b JOIN benchmark c ON c.item_id = b.item_id + 1")
def pick_equivalent(spark: SparkSession, sf: str) -> DataFrame:
    """Of every item and the next one the longer text, as of two variants."""
    b = table(spark, sf, "benchmark")
    c = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(c, "item_id").select("item_id", T.longer_variant(F.col("text"), F.col("other")).alias("pick"))


@query("SELECT o_orderpriority, CASE WHEN lower(p) IN ('low', 'medium', 'high', 'breaking') THEN lower(p) ELSE 'medium' END AS severity, count(*) AS n FROM (SELECT o_orderpriority, regexp_replace(o_orderpriority, '^[0-9]+-', '') AS p FROM orders) GROUP BY 1, 2")
def severity_norm(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(p, T.severity(F.regexp_replace(p, "^[0-9]+-", "")).alias("severity")).groupBy("o_orderpriority", "severity").agg(F.count("*").alias("n"))


_SAMPLE = r"regexp_replace(substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 8000), '^\s+|\s+$', '', 'g')"  # of texts of one paragraph
_GRAMS = """SELECT *, unnest([CASE WHEN i > 1 THEN substr(w, i, 1) END, CASE WHEN length(w) - i >= 1 THEN substr(w, i, 2) END, CASE WHEN length(w) - i >= 2 THEN substr(w, i, 3) END]) AS gram
FROM (SELECT *, CAST(unnest(range(1, length(word) + 2)) AS BIGINT) AS i, ' ' || word || ' ' AS w FROM {0})"""


def _detect_sql() -> str:
    """Profiles of all labelled texts, and each text by them; scripts decide by themselves."""
    scripts = " ".join(f"WHEN {share} >= {D.SCRIPT_SHARE} THEN {{'lang': '{lang}', 'confidence': least(1.0, {share})}}" for lang, p in D.SCRIPTS.items() for share in [f"len(regexp_extract_all(sample, '{p}'))::DOUBLE / letters"])
    return rf"""WITH cw AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) AS word FROM documents WHERE lang IS NOT NULL) WHERE word <> '' GROUP BY ALL),
cg AS (SELECT lang, gram, CAST(sum(n) AS BIGINT) AS n FROM ({_GRAMS.format('cw')}) WHERE gram IS NOT NULL GROUP BY ALL),
k AS (SELECT * FROM cg QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= {NG.SIZE}),
t AS (SELECT lang, sum(n) AS total FROM k GROUP BY lang),
p AS (SELECT g.gram, t.lang, CAST(round({NG.SCALE} * ln((coalesce(k.n, 0) + 0.5) / (t.total + {NG.SIZE / 2}))) AS BIGINT) AS score FROM (SELECT DISTINCT gram FROM k) g CROSS JOIN t LEFT JOIN k ON k.gram = g.gram AND k.lang = t.lang),
d AS (SELECT doc_id, lang AS given, sample, CASE WHEN length(sample) >= {D.SHORT} THEN CASE {scripts} END END AS script
FROM (SELECT *, greatest(1, len(regexp_extract_all(sample, '\p{{L}}'))) AS letters FROM (SELECT doc_id, lang, {_SAMPLE} AS sample FROM documents))),
dw AS (SELECT doc_id, word FROM (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(sample), '[^\p{{L}}]+'))) AS word FROM d WHERE length(sample) >= {D.SHORT} AND script IS NULL) WHERE word <> ''),
s AS (SELECT x.doc_id, p.lang, sum(p.score) AS score, count(*) AS n FROM ({_GRAMS.format('dw')}) x JOIN p USING (gram) GROUP BY ALL),
b AS (SELECT doc_id, arg_min(lang, (-score, lang)) AS lang, max(score) AS top, any_value(n) AS n FROM s GROUP BY doc_id),
c AS (SELECT b.doc_id, b.lang, round(1 / sum(exp((s.score - b.top) / ({NG.SCALE} * sqrt(b.n)))), 4) AS confidence FROM b JOIN s USING (doc_id) GROUP BY ALL)
SELECT d.doc_id, d.given, coalesce(d.script.lang, c.lang, 'unknown') AS detected, coalesce(d.script.confidence, c.confidence, 0.0)::DOUBLE AS confidence FROM d LEFT JOIN c USING (doc_id)"""


@query(_detect_sql())
def lang_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Every document by the n-gram profiles of the table's own languages."""
    docs = _docs(spark, sf)
    found = NG.detect(docs.select("doc_id", F.col("lang").alias("given"), "text"), "text", NG.profile(docs.select("lang", "text")))
    return found.select("doc_id", "given", F.coalesce("found.lang", F.lit("unknown")).alias("detected"), F.coalesce("found.confidence", F.lit(0.0)).alias("confidence"))


@query(f"SELECT given, detected, count(*) AS n FROM ({_detect_sql()}) GROUP BY given, detected")
def lang_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return lang_detect(spark, sf).groupBy("given", "detected").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, given, detected FROM ({_detect_sql()}) WHERE given IS NOT NULL AND detected <> 'unknown' AND detected <> given")
def source_lang_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    rows = lang_detect(spark, sf)
    return rows.where(D.source_mismatch(F.col("given"), F.col("detected"))).select("doc_id", "given", "detected")


def _glossaries(spark: SparkSession, sf: str) -> DataFrame:
    """Two glossaries of every region as JSON: its nations, every third as itself, and the even ones again with other translations."""
    n = table(spark, sf, "nation")
    one = F.when(F.col("n_nationkey") % 3 == 0, F.lower("n_name")).otherwise(F.reverse("n_name"))
    pair = lambda value: F.map_from_entries(F.collect_list(F.struct("n_name", value)))
    two = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("x"), "n_name"))
    second = F.map_filter(pair(F.coalesce(two, F.lit(" "))), lambda k, v: v != " ")
    return n.groupBy("n_regionkey").agg(F.to_json(pair(one)).alias("one"), F.to_json(second).alias("two"))


@query("SELECT n_regionkey, string_agg(t, '|' ORDER BY t) AS tokens FROM (SELECT DISTINCT n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE reverse(n_name) END AS t FROM nation) GROUP BY n_regionkey")
def glossary_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _glossaries(spark, sf).select("n_regionkey", F.array_join(G.tokens(G.parse(F.col("one"))), "|").alias("tokens"))


@query("""SELECT n_regionkey, string_agg('- ' || chr(39) || n_name || chr(39) || CASE WHEN keep THEN ': keep unchanged (do not translate)' ELSE ' → ' || chr(39) || CASE WHEN n_nationkey % 2 = 0 THEN 'x' || n_name ELSE reverse(n_name) END || chr(39) END, chr(10) ORDER BY keep DESC, n_name) AS block
FROM (SELECT *, n_nationkey % 3 = 0 AS keep FROM nation) GROUP BY n_regionkey""")
def glossary_merge(spark: SparkSession, sf: str) -> DataFrame:
    block = G.prompt_block(G.merge(G.parse(F.col("one")), G.parse(F.col("two"))))
    return _glossaries(spark, sf).select("n_regionkey", F.replace(block, F.lit("Glossary terms:\n"), F.lit("")).alias("block"))


@query(r"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '^(?i:https?)://') THEN 'scheme' WHEN host = '' THEN 'host' WHEN host IN ('localhost', 'localhost.localdomain') THEN 'localhost'
WHEN regexp_matches(host, '^(127|10)(\.[0-9]{1,3}){3}$|^192\.168(\.[0-9]{1,3}){2}$|^169\.254(\.[0-9]{1,3}){2}$|^172\.(1[6-9]|2[0-9]|3[01])(\.[0-9]{1,3}){2}$') THEN 'address' END AS error
FROM (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM
(SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'ftp://x/y' WHEN 1 THEN 'http://10.0.' || page_id % 200 || '.1:80/a' WHEN 2 THEN 'https://172.20.1.9/' WHEN 3 THEN 'https://LocalHost/x' WHEN 4 THEN 'https://8.8.8.8/' ELSE url END AS url FROM pages))""")
def webhook_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Why pages' URLs, some replaced by others that a rule makes, could be no webhook's."""
    p = F.col("page_id")
    url = F.when(p % 7 == 0, "ftp://x/y").when(p % 7 == 1, F.concat(F.lit("http://10.0."), (p % 200).cast("string"), F.lit(".1:80/a"))).when(p % 7 == 2, "https://172.20.1.9/").when(p % 7 == 3, "https://LocalHost/x").when(p % 7 == 4, "https://8.8.8.8/").otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", U.webhook_error(url).alias("error"))


@query("""SELECT conv_id, turn AS chunk_index, 'translate-pass' || (turn % 2 + 1) || '-chunk-' || lpad(CAST(turn AS VARCHAR), 4, '0') || '.md' AS name FROM conversations""")
def checkpoint_names(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn").cast("int")
    return table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("chunk_index"), U.checkpoint_name(t % 2 + 1, t).alias("name"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as pages of their conversation: every third has no native text, every second one was recognised."""
    t, n = F.coalesce("text", F.lit("")), F.col("turn")
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("path"), n.alias("page_num"), F.when(n % 3 == 0, "").otherwise(t).alias("native"), F.when(n % 2 == 0, F.concat(t, F.lit(" seen"))).alias("ocr"))
    return P.page_rows(rows.withColumns({"method": F.lit("http"), "warning": F.lit(None).cast("string")}))


_PAGES = rf"""SELECT conv_id, page_num, CASE WHEN used THEN ocr ELSE native END AS text, CAST(length(CASE WHEN used THEN {_STRIP.replace('(text', '(ocr', 1)} ELSE {_STRIP.replace('(text', '(native', 1)} END) AS INTEGER) AS char_count, used AS ocr, CASE WHEN used THEN 'http' ELSE 'native' END AS method
FROM (SELECT *, length({_STRIP.replace('(text', '(native', 1)}) < 25 AND length({_STRIP.replace('(text', "(coalesce(ocr, '')", 1)}) > length({_STRIP.replace('(text', '(native', 1)}) AS used
FROM (SELECT conv_id, turn AS page_num, CASE WHEN turn % 3 = 0 THEN '' ELSE coalesce(text, '') END AS native, CASE WHEN turn % 2 = 0 THEN coalesce(text, '') || ' seen' END AS ocr FROM conversations))"""


@query(_PAGES)
def page_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Of each page the native or the recognised text, and what it counts for."""
    return _pages(spark, sf).select(F.col("path").alias("conv_id"), "page_num", "text", "char_count", "ocr", "method")


@query(f"SELECT conv_id, {_STRIP} || chr(10) AS text, pages, ocr_pages FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY page_num) AS text, CAST(count(*) AS INTEGER) AS pages, count(*) FILTER (ocr) AS ocr_pages FROM ({_PAGES}) GROUP BY conv_id)")
def paged_documents(spark: SparkSession, sf: str) -> DataFrame:
    return P.documents_of_pages(_pages(spark, sf)).select(F.col("path").alias("conv_id"), "text", "pages", "ocr_pages")


@query(rf"""SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (t <> '') AS text, CAST(count(*) FILTER (turn % 3 = 0) AS INTEGER) AS ocr_pages, sum(n)::BIGINT AS chars, CAST(count(*) AS INTEGER) AS pages
FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS n, {_STRIP.replace('(text', "(coalesce(text, '')", 1)} AS t FROM conversations) GROUP BY conv_id""")
def layout_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Layouts of conversations, a page per turn, read from their JSON; every third page was recognised."""
    n = F.col("turn")
    item = F.struct(F.col("text"), F.when(n % 3 == 0, 0.5).alias("confidence"))
    page = F.struct(n.alias("page_num"), "text", F.array(item).alias("text_items"))
    raw = table(spark, sf, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(page)).alias("pages"))).alias("raw"))
    rows = raw.select("conv_id", P.layout_pages(F.col("raw")).alias("p"))
    chars = F.aggregate(P.layout_stats(F.col("p")), F.lit(0).cast("long"), lambda s, x: s + x["char_count"])
    return rows.select("conv_id", P.text_of_layout(F.col("p")).alias("text"), P.layout_ocr_pages(F.col("p")).alias("ocr_pages"), chars.alias("chars"), F.size("p").alias("pages"))


@query("""SELECT file, backend, passed, CASE WHEN e THEN 'extract: no reader' ELSE concat_ws('; ', CASE WHEN chars < 120 THEN 'min_chars: ' || chars || ' chars (min 120)' END, CASE WHEN pages = 0 THEN 'pages: 0 pages' END,
CASE WHEN NOT same THEN 'hash: expected ' || substr(sha256(text || 'x'), 1, 12) || '… got ' || substr(sha256(text), 1, 12) END) END AS failures
FROM (SELECT *, NOT e AND chars >= 120 AND pages > 0 AND same AS passed FROM (SELECT item_id AS file, backend, text, length(text) AS chars, item_id % 5 AS pages, item_id % 7 = 0 AND backend = 'layout' AS e, item_id % 3 <> 0 AS same
FROM benchmark CROSS JOIN (VALUES ('native'), ('layout')) b(backend)))""")
def reader_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts as files that two backends have read, with other golden hashes for every third and no layout reader for every seventh."""
    i = F.col("item_id")
    both = table(spark, sf, "benchmark").withColumn("backend", F.explode(F.array(F.lit("native"), F.lit("layout"))))
    error = F.when((i % 7 == 0) & (F.col("backend") == "layout"), "no reader")
    rows = both.select(i.alias("file"), "backend", F.length("text").cast("long").alias("chars"), (i % 5).cast("int").alias("pages"), F.sha2("text", 256).alias("hash"), error.alias("error"))
    expected = F.when(i % 3 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    cases = both.select(i.alias("file"), "backend", F.lit(120).alias("min_chars"), expected.alias("golden_hash"))
    return E.scored(rows, cases).select("file", "backend", "passed", F.array_join("failures", "; ").alias("failures"))


@query("""SELECT batch, pos, CAST(sum(1) OVER w AS BIGINT) AS calls, CAST(sum(greatest(n, 0)) OVER w AS BIGINT) AS tokens_in, CAST(sum(n2) OVER w AS BIGINT) AS tokens_out
FROM (SELECT conv_id AS batch, turn AS pos, coalesce(length(text), 0) - 40 AS n, coalesce(length(text), 0) AS n2 FROM conversations) WINDOW w AS (PARTITION BY batch ORDER BY pos ROWS UNBOUNDED PRECEDING)""")
def running_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as calls, their lengths as tokens; counts below 0 are none."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    calls = table(spark, sf, "conversations").select(F.col("conv_id").alias("batch"), F.col("turn").alias("pos"), F.lit(1).cast("long").alias("calls"), (n - 40).alias("tokens_in"), n.alias("tokens_out"))
    return N.running_usage(calls)


@query("""SELECT conv_id AS job_id, CASE WHEN conv_id % 3 = 0 AND conv_id % 4 <> 3 THEN 'completed_with_warnings' WHEN conv_id % 4 = 3 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN conv_id % 3 = 0 THEN 'WEBHOOK_FAILED' END AS code
FROM (SELECT DISTINCT conv_id FROM conversations)""")
def undelivered_notices(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as ended jobs, the notices of every third of which failed."""
    job = F.col("job_id")
    jobs = table(spark, sf, "conversations").select(F.col("conv_id").alias("job_id")).distinct().withColumn("status", F.when(job % 4 == 3, "failed").otherwise("completed"))
    sent = jobs.select("job_id", (job % 3 != 0).alias("delivered"), F.when(job % 3 == 0, "down").alias("error"))
    after, issues = N.after_notices(jobs, sent)
    return after.join(issues.select("job_id", "code"), "job_id", "left").select("job_id", "status", "code")


@query("""SELECT event_id, error FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'force and resume exclude each other' WHEN event_id % 3 = 0 AND event_id % 5 <> 0 THEN 'nothing to resume'
WHEN event_id % 7 = 0 AND event_id % 2 <> 0 AND event_id % 3 <> 0 THEN 'the job exists' END AS error FROM events) WHERE error IS NOT NULL""")
def start_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Events as jobs that are asked for: every second to be replaced, every third resumed, every fifth with a checkpoint, every seventh there."""
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", N.start_error(e % 7 == 0, e % 5 == 0, e % 2 == 0, e % 3 == 0).alias("error")).where("error IS NOT NULL")
