"""SQL for the queries that SQL can express, for DuckDB."""

import math

from .license_texts import TEMPLATES
from .licenses import CONTAINMENT, PHRASES, words
from .url_filter import OP6_SQL

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM d)),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
x AS (SELECT doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS p FROM d)),
kept AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.p) AS t FROM x ANTI JOIN r ON r.doc_id = x.doc_id AND r.p = x.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP7_SQL = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS k FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 100)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b
  FROM (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
        FROM (SELECT doc_id, i, lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM later))
  GROUP BY doc_id, g),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low, a AS high FROM spans
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(length(h)) // 2 FROM d LEFT JOIN spans ON spans.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (SELECT d.doc_id, string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' ORDER BY low) AS k FROM d JOIN gaps ON gaps.doc_id = d.doc_id GROUP BY d.doc_id),
s AS (SELECT doc_id, count(*) AS n, sum(b - a) AS bytes FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(s.bytes, 0) AS BIGINT) AS n_removed, CAST(coalesce(s.n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.y) AS component_id, coalesce(k.n_links, 0) AS n_links
FROM d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.x = d.doc_id GROUP BY d.doc_id, n.n, k.n_links
"""

_SEQUENCES = [(k, label, [w.decode() for w in words(t)]) for k, (label, t) in enumerate(TEMPLATES)]
_TEMPLATE_WORDS = ", ".join(f"({k}, '{w}')" for k, _, t in _SEQUENCES for w in dict.fromkeys(t))
_TEMPLATE_SIZES = ", ".join(f"({k}, '{label}', {len(t)}, {m}, {max(1, math.ceil(CONTAINMENT * m - 1e-9))})" for k, label, t in _SEQUENCES for m in [len(set(t))])
_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, p - 1 AS place FROM x WHERE " + " AND ".join(f"ws[p + {i}] = '{w}'" for i, w in enumerate(phrase.split())) for phrase, label in PHRASES
)

OP10_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
x AS (SELECT doc_id, ws, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS p FROM d)),
places AS ({_PLACES}),
base AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
hits AS (SELECT doc_id, k, p, x.word FROM x JOIN (VALUES {_TEMPLATE_WORDS}) t(k, word) ON t.word = x.word),
sizes AS (SELECT * FROM (VALUES {_TEMPLATE_SIZES}) s(k, label, length, size, need)),
likely AS (SELECT doc_id, k FROM hits JOIN sizes USING (k) GROUP BY doc_id, k, need HAVING count(DISTINCT word) >= need),
blocks AS (
  SELECT a.doc_id, s.label, a.k, a.p, any_value(size) AS size, any_value(need) AS need, count(DISTINCT b.word) AS held
  FROM likely JOIN hits a USING (doc_id, k) JOIN sizes s USING (k)
  JOIN hits b ON b.doc_id = a.doc_id AND b.k = a.k AND b.p >= a.p AND b.p < a.p + s.length GROUP BY a.doc_id, s.label, a.k, a.p),
met AS (SELECT doc_id, list(DISTINCT label) AS labels, max(CAST(held AS DOUBLE) / size) AS best FROM blocks WHERE held >= need GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(base.a AS BIGINT) AS first_word, CAST(base.b AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(met.labels, [])))), ',') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(met.best, 0) END AS score
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN met ON met.doc_id = d.doc_id
"""

ORACLE = {
    "op10_license_scan": OP10_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op6_url_filter": OP6_SQL,
    "op7_suffix_array_dedup": OP7_SQL,
    "op8_ngram_jaccard_join": OP8_SQL,
}
