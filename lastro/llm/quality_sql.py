"""The quality rules in DuckDB's SQL."""

from __future__ import annotations

from lastro.llm.quality import CLOSING, KEEP, PHRASE_WORDS, PHRASES, SHORT, SYMBOLS

WORD = r"[^\x20\x09-\x0D]+"
SOLID = "length(regexp_replace({}, '[\\x20\\x09-\\x0D]', '', 'g'))"
PHRASE = " OR ".join(f"contains(lower(line), '{p}')" for p in PHRASES)
CLOSES = CLOSING.replace("'", "''")

QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '{WORD}')) AS w, generate_subscripts(regexp_extract_all(text, '{WORD}'), 1) AS i FROM d),
t AS (SELECT r, i, w AS a, lead(w, 1) OVER v AS b, lead(w, 2) OVER v AS c FROM w WINDOW v AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, c, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM t) WHERE n > 1 AND c IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (SELECT DISTINCT r, unnest(string_split(text, chr(10))) AS line FROM d),
good AS (
  SELECT r, sum({SOLID.format("line")}) AS kept FROM (
    SELECT r, line, len(regexp_extract_all(line, '{WORD}')) AS n, length(regexp_replace(line, '[^|]', '', 'g')) AS bars, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols
    FROM lines)
  WHERE n > 0 AND NOT (100 * symbols > {SYMBOLS} * {SOLID.format("line")} OR (n < {SHORT} AND NOT regexp_matches(line, '{CLOSES}'))
    OR 4 * bars >= n OR (n <= {PHRASE_WORDS} AND ({PHRASE}))) GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY r),
f AS (
  SELECT doc_id, CAST(len(regexp_extract_all(text, '{WORD}')) AS BIGINT) AS n_words, CAST({SOLID.format("text")} AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(good.kept, 0) AS kept_chars
  FROM d LEFT JOIN rep USING (r) LEFT JOIN good USING (r) LEFT JOIN dup USING (r)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 100 * kept_chars < {KEEP} * word_chars) AS kept FROM g
"""
