"""DuckDB SQL for the dealt operators that SQL can express."""

from __future__ import annotations

from lorespring.llm.quality import STOP_WORDS
from lorespring.llm.url_filters import RULES

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents
), grams AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), reach AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1
), lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1
), base AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(reach.n, 0)::BIGINT AS n_repeat_words,
    coalesce(lines.n, 0) AS n_lines,
    len(list_filter(list_transform(ws, lambda x: lower(x)), lambda x: x IN ({", ".join(f"'{s}'" for s in dict.fromkeys(STOP_WORDS))}))) AS n_stop,
    len(ws) - len(list_distinct(list_transform(ws, lambda x: lower(x)))) AS n_again,
    length(regexp_replace(array_to_string(ws, ''), '\P{{Latin}}+', '', 'g')) AS n_latin,
    length(regexp_replace(array_to_string(ws, ''), '\P{{L}}+', '', 'g')) AS n_letters
  FROM w LEFT JOIN reach USING (doc_id) LEFT JOIN lines USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND word_chars / greatest(n_words, 1)::DOUBLE BETWEEN 2.0 AND 14.0
    AND n_symbols / greatest(n_words, 1)::DOUBLE <= 0.25
    AND (greatest(n_stop, n_again) / greatest(n_words, 1)::DOUBLE >= 0.03 OR n_letters - n_latin > n_latin)
    AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.5 AS kept
FROM base
"""

OP5 = rf"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS lot
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][turn + 1]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap,
    [1.5, 1.0, 0.5][turn + 1]::DOUBLE AS a, [0.5, 1.0, 1.5][turn + 1]::DOUBLE AS b FROM sources
), levels AS (
  SELECT p.source, p.cap / p.weight AS edge, (SELECT sum(least(q.cap, q.weight * (p.cap / p.weight))) FROM weighed q) AS filled
  FROM weighed p
), edge AS (
  SELECT coalesce(max(edge) FILTER (WHERE filled < (SELECT sum(source_size) FROM weighed)), 0) AS low FROM levels
), level AS (
  SELECT ((SELECT sum(source_size) FROM weighed)
      - coalesce(sum(cap) FILTER (WHERE cap / weight <= low), 0)) / sum(weight) FILTER (WHERE cap / weight > low) AS height
  FROM weighed, edge
), goals AS (
  SELECT weighed.*, least(cap, coalesce(height, 0) * weight) AS target FROM weighed, level
), run AS (
  SELECT doc_id, s.source, size, source_size, target, a, b, round(target)::BIGINT AS goal,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY lot, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), done AS (
  SELECT *, least(1.0, (start + size / 2.0) / greatest(target, 1.0))::DOUBLE AS y FROM run
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - source_size - start))
    + greatest(0, least(size, goal - 2 * source_size - start)))::BIGINT AS taken,
  CASE WHEN least(size, goal - start) > 0 THEN
    CASE WHEN a = b THEN y ELSE (sqrt(a * a + (b - a) * (a + b) * y) - a) / (b - a) END END AS position
FROM done
"""

_BLOCKED = " OR ".join(f"regexp_matches(host || path, '{r.pattern}')" for r in RULES if not r.base)

OP7 = rf"""
WITH urls AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule, host, path, verdict) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'block'), ('example.net/de/8', 'example.net', '/de/8', 'block'),
  ('org/es/', 'org', '/es/', 'block')
), best AS (
  SELECT u.page_id, u.host, u.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS said
  FROM urls u LEFT JOIN rules r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(said,
  CASE WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (
  SELECT a AS doc_id, a AS here FROM both_ways UNION SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON l.a = r.here
), firsts AS (SELECT doc_id, min(here) AS first FROM reached GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(first, w.doc_id) AS component_id
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN firsts USING (doc_id)
"""

OP3 = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM valid x JOIN valid y
    ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93
), reached AS (
  SELECT a AS vec_id, a AS here FROM links UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.here
), firsts AS (SELECT vec_id, min(here) AS first FROM reached GROUP BY 1
), counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(first, e.vec_id) AS component_id,
  coalesce(first, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.vec_id = e.vec_id LEFT JOIN firsts f ON f.vec_id = e.vec_id
"""


OP11 = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda c, d: list_reduce(list_prepend(xor(c, d), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, i, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND i <= h
  UNION ALL SELECT c.conv_id, i, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND i > h
), sequences AS (
  SELECT c.conv_id, coalesce(list({'r': role, 't': text} ORDER BY i) FILTER (i IS NOT NULL), []) AS s
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY 1
), prefixes AS (
  SELECT conv_id, d, s[1:d] AS p, len(s) = d AS ends FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM sequences)
), nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY 1, 2
), children AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2
), owned AS (
  SELECT nodes.p, nodes.d, n IS NULL AS leaf, (n_convs - 1) * coalesce(length(nodes.p[nodes.d].t), 0) AS saved
  FROM nodes LEFT JOIN children USING (p, d)
), below AS (
  SELECT p[1:a] AS p, a AS d, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM owned) GROUP BY 1, 2
)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
  n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (p, d) LEFT JOIN children c USING (p, d)
LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.p[1:n.d - 1] AND n.d > 0
"""

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array({_LOWER}, '{_BREAKS}'), lambda x: x <> '') AS ws
  FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array({_LOWER}, '{_BREAKS}'), lambda x: x <> '') AS ws FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM items WHERE len(ws) > 0)
), places AS (
  SELECT row, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g
  FROM (SELECT row, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM grams))
), hits AS (SELECT DISTINCT row, i, n, item_id FROM places JOIN grams USING (n, g)
), covered AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1
), named AS (
  SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY 1
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": OP11, "op13_decontamination": OP13, "op3_embedding_near_dedup": OP3, "op4_ngram_jaccard": OP4, "op2_quality_rules": OP2, "op5_source_mixing": OP5, "op7_url_filters": OP7}
