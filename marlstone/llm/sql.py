"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (
  SELECT rid, unnest(range(1, len(ws) - 3)) AS p, ws FROM w WHERE len(ws) >= 5),
k AS (
  SELECT rid, p, count(*) OVER (PARTITION BY rid, ws[p], ws[p+1], ws[p+2], ws[p+3], ws[p+4]) AS n FROM g),
r AS (
  SELECT rid, count(DISTINCT p + o) AS n_repeat FROM k, (SELECT unnest(range(5)) AS o) WHERE n > 1 GROUP BY rid),
s AS (
  SELECT doc_id, source, len(ws) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)),
b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY source),
m AS (
  SELECT sum(n) AS n, sum(f) AS f, least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) AS mean,
         greatest(sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2
                  - least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) * (1 - least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6)) * count(*) / sum(n), 0) AS spread
  FROM h),
c AS (
  SELECT mean, least(greatest(CASE WHEN spread > 0 THEN mean * (1 - mean) / spread - 1 ELSE 1e4 END, 1.0), 1e4) AS weight FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (h.f + c.mean * c.weight) / (h.n + c.weight) <= 0.5 AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source, c
"""

NEAR_DUP = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (
  SELECT x AS doc_id, y AS other FROM u
  UNION SELECT r.doc_id, u.y FROM reach r JOIN u ON u.x = r.other),
comp AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS ws
  FROM documents),
o AS (SELECT rid, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0)::HUGEINT AS v
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN v USING (lang)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n)::HUGEINT + 5)) // (any_value(t) + 5 * any_value(v)) AS q
  FROM c JOIN (SELECT lang, sum(total)::HUGEINT AS t, any_value(v) AS v FROM g GROUP BY lang) USING (lang) GROUP BY lang, term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
