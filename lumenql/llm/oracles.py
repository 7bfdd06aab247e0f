"""DuckDB SQL that gives the same rows as a query, where SQL can express it."""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_MEASURES = ("symbols", "dup_lines", "marks", "word_length")
_SLACK = {"symbols": 50, "dup_lines": 350, "marks": 100, "word_length": 4000}

_FEATURES = rf"""
raw AS (
  SELECT doc_id, lang, source, {_WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
flat AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(array_to_string(ws, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         length(regexp_replace(array_to_string(ws, ''), '[^!]+', '', 'g')) AS n_marks,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, lang, source
  FROM raw),
grams AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM raw WHERE len(ws) >= 3)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
covered AS (
  SELECT doc_id, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT doc_id, i + k AS j FROM again, (VALUES (0), (1), (2)) AS o(k) WHERE n >= 2) GROUP BY doc_id),
features AS (
  SELECT f.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0) AS symbols,
         coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) AS dup_lines,
         coalesce(n_marks * 1000 // nullif(n_words, 0), 0) AS marks,
         coalesce(word_chars * 1000 // nullif(n_words, 0), 0) AS word_length
  FROM flat f LEFT JOIN covered c USING (doc_id))
"""


def _level(name: str, lang: str, source: str) -> str:
    """Fences of one level of sketches."""
    long = " UNION ALL ".join(f"SELECT {lang} AS lang, {source} AS source, '{m}' AS metric, {m} AS v FROM features WHERE n_words > 0" for m in _MEASURES)
    slack = "CASE metric " + " ".join(f"WHEN '{m}' THEN {s}" for m, s in _SLACK.items()) + " END"
    return f"""
{name}_bins AS (
  SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS b, count(*) AS n
  FROM ({long}) GROUP BY ALL),
{name}_run AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM {name}_bins),
{name}_q AS (
  SELECT lang, source, metric, max(total) AS total, min(b) FILTER (4 * upto >= total) AS q25, min(b) FILTER (4 * upto >= 3 * total) AS q75
  FROM {name}_run GROUP BY ALL),
{name} AS (
  SELECT lang, source, max(total) AS total, {", ".join(f"max(fence) FILTER (metric = '{m}') AS {m}" for m in _MEASURES)}
  FROM (SELECT *, q75 + 4 * (q75 - q25) + {slack} AS fence FROM {name}_q) GROUP BY ALL)"""


def _pick(m: str) -> str:
    return f"CASE WHEN a.total >= 30 THEN a.{m} WHEN b.total >= 30 THEN b.{m} ELSE c.{m} END"


QUALITY = f"""
WITH {_FEATURES}, {_level("by_source", "lang", "source")}, {_level("by_lang", "lang", "NULL::VARCHAR")}, {_level("corpus", "NULL::VARCHAR", "NULL::VARCHAR")},
judged AS (
  SELECT f.*, f.n_words < 50 OR 100 * f.n_repeat_words > 50 * f.n_words AS base_failed,
         {" AND ".join(f"coalesce(f.{m} <= {_pick(m)}, true)" for m in _MEASURES)} AS within
  FROM features f
  LEFT JOIN by_source a ON f.lang IS NOT DISTINCT FROM a.lang AND f.source IS NOT DISTINCT FROM a.source
  LEFT JOIN by_lang b ON f.lang IS NOT DISTINCT FROM b.lang
  LEFT JOIN corpus c ON true)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND within AS kept
FROM judged
"""

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
         greatest(0.1e0, 1.0e0 - 5.0e0 * length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) / greatest(length(coalesce(text, '')), 1)) AS q,
         md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || chr(31) || 'mix') AS h
  FROM documents),
k AS (SELECT *, -ln((CAST('0x' || substr(h, 1, 12) AS BIGINT)::DOUBLE + 0.5e0) / 281474976710656e0) / q AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [3e0, 1e0, 2e0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w, source_size * 2e0 AS cap FROM s),
f AS (
  SELECT *, sum(source_size) OVER () * 1.5e0 - coalesce(sum(cap) OVER o, 0e0) AS open_budget, sum(w) OVER () - coalesce(sum(w) OVER o, 0e0) AS open_w,
         row_number() OVER (ORDER BY cap / w, source IS NULL, source) AS turn
  FROM w WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min(open_budget / open_w, turn) AS level FROM f WHERE cap / w >= open_budget / open_w),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM f, lv),
e AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0)), 0)::BIGINT AS epochs,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.h, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((epochs + CASE WHEN upto - size / 2e0 <= target - epochs * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM e
"""

ORACLES = {"op2_quality_rules": QUALITY, "op9_mixing": MIXING}
