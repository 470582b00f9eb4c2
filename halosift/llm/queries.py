"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from halosift.llm import align, audit, html, langid, leaks, licenses, lm, near, passages, pieces, quality, secrets, simhash
from halosift.llm.registry import QUERIES, SQL, query
from halosift.llm.tables import table

__all__ = ["QUERIES", "SQL"]

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_SQL = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM dw WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.r = links.a),
least_one AS (SELECT a AS doc_id, min(r) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least_one LEFT JOIN sizes USING (doc_id)
"""


def _secrets_sql() -> str:
    """Matches with their places: a match begins after all gaps and matches before it."""
    kinds = []
    for order, (kind, pattern, group) in enumerate(secrets.KINDS):
        quoted = pattern.replace("'", "''")
        value = f"list_transform(m, lambda x: regexp_extract(x, '{quoted}', {group}))" if group else "m"
        keep = f"length(v) >= {secrets.LEAST_VALUE}" if kind == "assign" else "true"
        if kind == "key":
            keep = "regexp_matches(m1, '[0-9]') AND regexp_matches(m1, '[A-Z]') AND regexp_matches(m1, '[a-z]')"
        kinds.append(f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, pos AS a, pos + length(m1) AS e FROM (
  SELECT doc_id, m[i] AS m1, v[i] AS v, CAST(list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x)))
         + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS BIGINT) AS pos
  FROM (SELECT doc_id, m, g, {value} AS v, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{quoted}') AS m, string_split_regex(text, '{quoted}') AS g FROM documents WHERE text IS NOT NULL)))
WHERE {keep}""")
    weak = f"""found f WHERE o < 3 OR EXISTS (SELECT 1 FROM found q WHERE q.doc_id = f.doc_id
  AND CASE WHEN f.kind = 'key' THEN q.kind IN ('access', 'login', 'endpoint') ELSE q.kind IN ('assign', 'hex', 'key') END
  AND q.a < f.e + {secrets.SCOPE} AND q.e > f.a - {secrets.SCOPE} AND NOT (q.a < f.e AND q.e > f.a))"""
    text = "string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, o)"
    return f"""WITH found AS ({" UNION ALL ".join(kinds)}), kept AS (SELECT * FROM {weak}),
per AS (SELECT doc_id, count(CASE WHEN o = 0 THEN 1 END) AS x, count(CASE WHEN o = 1 THEN 1 END) AS y, count(CASE WHEN o = 2 THEN 1 END) AS z,
  {text} AS spans, {text} FILTER (o < 3) AS base FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(x, 0) AS BIGINT) AS n_assign, CAST(coalesce(y, 0) AS BIGINT) AS n_access, CAST(coalesce(z, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN per USING (doc_id)"""


def _licenses_sql() -> str:
    word = licenses.WORD
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in licenses.PHRASES)
    known = ", ".join(f"('{label}', {listed(words)}, {c}, {span})" for label, words, c, span in licenses.notices())
    return f"""WITH phrases(p, label, n) AS (VALUES {phrases}), notices(label, words, c, span) AS (VALUES {known}),
dw AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{word}') AS w FROM documents),
places AS (SELECT doc_id, label, i - 1 AS pos FROM (SELECT doc_id, w, p, label, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, phrases WHERE len(w) >= n)
  WHERE w[i] = split_part(p, ' ', 1) AND array_to_string(list_slice(w, i, i + n - 1), ' ') = p),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS f, max(pos) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
spots AS (SELECT doc_id, label, c, span, len(words) AS size, pos, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM dw)
  JOIN (SELECT *, unnest(words) AS word FROM notices) USING (word)),
runs AS (SELECT doc_id, label, c, size, count(DISTINCT word) OVER (PARTITION BY doc_id, label ORDER BY pos RANGE BETWEEN CURRENT ROW AND span - 1 FOLLOWING) AS k
  FROM spots),
met AS (SELECT doc_id, label, k / CAST(size AS DOUBLE) AS share FROM runs WHERE k >= c),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM met UNION SELECT doc_id, label FROM places) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, f AS first_word, l AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(named.labels, '') AS labels,
  greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END) AS score
FROM dw LEFT JOIN base ON base.doc_id = dw.doc_id LEFT JOIN named ON named.doc_id = dw.doc_id LEFT JOIN best ON best.doc_id = dw.doc_id"""


LEAKS_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, len(ww) AS n, array_to_string(ww, ' ') AS win FROM (
    SELECT item, list_slice(w, i, i + least(10, len(w)) - 1) AS ww
    FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item FROM places JOIN windows USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered ON covered.doc_id = dw.doc_id LEFT JOIN named ON named.doc_id = dw.doc_id
"""


@query(LEAKS_SQL)
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


@query(NEAR_SQL)
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.report(table(spark, sf_dir, "documents"))


@query()
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(table(spark, sf_dir, "documents"))


@query()
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"))


@query(_secrets_sql())
def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


@query(_licenses_sql())
def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


@query()
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(table(spark, sf_dir, "documents"))


@query()
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.report(table(spark, sf_dir, "pages"))


@query()
def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS m FROM d GROUP BY t),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
cut AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^ 	-
]+') AS w FROM d),
fails AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > m, false) AS e, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad
  FROM cut JOIN firsts USING (t) LEFT JOIN said USING (doc_id)),
masks AS (
  SELECT part, CASE WHEN a THEN 1 ELSE 0 END + CASE WHEN b THEN 2 ELSE 0 END + CASE WHEN c THEN 4 ELSE 0 END
    + CASE WHEN d THEN 8 ELSE 0 END + CASE WHEN e THEN 16 ELSE 0 END AS mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad
  FROM fails GROUP BY ALL),
letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(list_slice(bits, 1, step - 1)), 0)::BIGINT AS before
  FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS step FROM orders)),
hits AS (
  SELECT part, filter_order, step, bit, n, good, bad, mask = bit AS alone, (mask & bit) <> 0 AS f, (mask & before) <> 0 AS gone
  FROM masks, steps),
res AS (
  SELECT part, filter_order, step, any_value(bit) AS bit, sum(CASE WHEN NOT f AND NOT gone THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN f AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN f AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN f AND NOT gone THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN f AND NOT gone THEN bad ELSE 0 END) AS toxic_lost
  FROM hits GROUP BY part, filter_order, step),
shares AS (SELECT part, bit, sum(removed) AS shapley FROM res GROUP BY part, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM res JOIN shares USING (part, bit)
"""


@query(AUDIT_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.report(table(spark, sf_dir, "documents"))
