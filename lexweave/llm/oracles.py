"""SQL that gives the rows of the queries in the registry."""

ORACLES: dict[str, str] = {}

ORACLES["op10_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS holder FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder = page_id THEN NULL ELSE holder END AS refers_to
FROM m
"""

ORACLES["op12_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT row, lang, source, unnest(terms) AS term FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS df FROM t GROUP BY ALL
), k AS (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS lang_n FROM c GROUP BY ALL HAVING sum(df) >= 10
), l AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY ALL
), g AS (
  SELECT o.lang, o.source, coalesce(l.v, 0) AS v, coalesce(l.lang_total, 0) AS lang_total,
         coalesce((SELECT sum(n) FROM c JOIN k USING (lang, term) WHERE c.lang = o.lang AND c.source = o.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN l ON o.lang = l.lang
), e AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST(1000000000 * (coalesce(c.n, 0) + 2) AS HUGEINT) // CAST(g.total + 2 * g.v AS HUGEINT) AS p,
         1 + 1000000000 * (k.lang_n + 2) // CAST(g.lang_total + 2 * g.v AS HUGEINT) AS q
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term WHERE a.source <> b.source GROUP BY ALL
), u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM e WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM u QUALIFY part = 'pair' OR rank <= 10
"""
