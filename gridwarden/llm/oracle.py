"""DuckDB SQL of the queries that SQL can express, each over the whole of its table."""

from __future__ import annotations

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
WORD_LIST = f"coalesce({WORDS.format('text')}, [])"

MIX_SOURCES = f"""
WITH d AS (
  SELECT doc_id, source, len({WORD_LIST}) AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * CAST(sum(size) AS BIGINT) AS cap,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source
), l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, cap / weight) FROM l WHERE level <= cap / weight)), cap) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), o AS (
  SELECT d.*, e.source_size, e.target, epochs, CAST(floor(target - epochs * source_size) AS BIGINT) AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, source, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM o
"""

QUALITY_RULES = f"""
WITH w AS (
  SELECT doc_id, source, text, {WORD_LIST} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS v FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3))) AS i FROM w)
), again AS (
  SELECT doc_id, v FROM windows GROUP BY ALL HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM windows SEMI JOIN again USING (doc_id, v) CROSS JOIN range(5) r(k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base, 100 * n_symbols > 20 * word_chars AS symbols, 100 * n_dup_lines > 50 * n_lines AS dup FROM m
), h AS (
  SELECT source, count(*) AS n, x.rule AS rule, sum(x.failed::INT) AS k FROM f, unnest([{{'rule': 'base', 'failed': base}}, {{'rule': 'symbols', 'failed': symbols}}, {{'rule': 'dup', 'failed': dup}}]) u(x) GROUP BY source, x.rule
), p AS (
  SELECT rule, sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) - pow(sum(k) / sum(n), 2) - (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) * (count(*) - 1) / sum(n) AS between_hosts FROM h GROUP BY rule
), q AS (
  SELECT rule, m, CASE WHEN between_hosts > 0 THEN least(1e6, greatest(1, m * (1 - m) / between_hosts - 1)) ELSE 1e6 END AS s FROM p
), r AS (
  SELECT source, max((k + m * s) / (n + s)) AS rate FROM h JOIN q USING (rule) GROUP BY source
)
SELECT doc_id, f.source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed, round(rate, 6) AS host_rate, NOT base AND rate <= 0.5 AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce({WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, v FROM (SELECT doc_id, array_to_string(ws[i : i + 4], ' ') AS v FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0))
), n AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.v = b.v AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT reach.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reach.b) AS component_id, min(reach.b) = reach.a AS kept FROM reach LEFT JOIN n ON n.doc_id = reach.a GROUP BY reach.a
"""

REPEATED_STRINGS = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS v FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 99))) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY doc_id, i) AS r FROM strings) WHERE r > 1
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM later)) GROUP BY doc_id, g
), edges AS (
  SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a, b) AS next FROM (SELECT * FROM spans UNION ALL SELECT doc_id, 0, 0 FROM d)
)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) FILTER (b > a) AS n_spans,
       sha256(unhex(string_agg(substr(h, 2 * b + 1, 2 * (coalesce(next, len(h) // 2) - b)), '' ORDER BY b))) AS kept_sha256
FROM d JOIN edges USING (doc_id) GROUP BY d.doc_id, h
"""
