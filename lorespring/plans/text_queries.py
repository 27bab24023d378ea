"""Normalised texts, ids, terms and sizes over ``documents``, ``conversations``, ``pages`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespring.functions import text as T
from lorespring.plans.registry import query, read

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_WORDS = r"regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Pc}]+')"


@query(r"""
SELECT doc_id, trim(regexp_replace(array_to_string(list_filter(list_transform(
    string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
    lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,
      'https?://(?:[a-zA-Z0-9]|[$-_@.&+]|[!*\\(),]|%[0-9a-fA-F]{2})+', '[URL]', 'g'),
      'www\.(?:[a-zA-Z0-9]|[$-_@.&+]|[!*\\(),]|%[0-9a-fA-F]{2})+', '[URL]', 'g'),
      '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b', '[EMAIL]', 'g'), '[\s\x0b\x85\p{Z}]+', ' ', 'g'))),
    lambda x: x <> ''), ' '), '', '')) AS content
FROM documents""")
def normalised_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", T.normalise(F.col("text")).alias("content"))


@query(r"""
SELECT conv_id, turn, regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]', '', 'g') AS content FROM conversations""")
def normalised_turns(spark, sf_dir):
    profile = T.Profile(lowercase=True, punctuation=True, whitespace=False, strip=False)
    turns = read(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", T.normalise_line(F.col("text"), profile).alias("content"))


@query(r"""
WITH lines AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines FROM documents)
SELECT doc_id,
  array_to_string(list_filter(list_transform(lines,
    lambda x: trim(regexp_replace(x, '[\s\x0b\x85\p{Z}]+', ' ', 'g'))), lambda x: x <> ''), ' ') AS minimal,
  array_to_string(list_filter(list_transform(lines, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x,
    '\p{Nd}+', '', 'g'), '[^a-zA-Z0-9\s\x0b\x85\p{Z}.,!?;:''-]', '', 'g'), '[\s\x0b\x85\p{Z}]+', ' ', 'g'))), lambda x: x <> ''), ' ') AS bare
FROM lines""")
def bare_documents(spark, sf_dir):
    """Each text by the smallest profile, and without numbers and special characters."""
    docs, bare = read(spark, sf_dir, "documents"), T.Profile(numbers=True, special=True)
    return docs.select(
        "doc_id",
        T.normalise(F.col("text"), T.MINIMAL).alias("minimal"),
        T.normalise(F.col("text"), bare).alias("bare"),
    )


@query("""
SELECT doc_id, sha256(source || doc_id::VARCHAR || text) AS document_id, sha256(text) AS content_id FROM documents""")
def document_ids(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        T.digest(F.col("source"), F.col("doc_id"), F.col("text")).alias("document_id"),
        T.digest(F.col("text")).alias("content_id"),
    )


@query("""
SELECT conv_id, turn, sha256(concat_ws(chr(0), 'p' || (conv_id % 7)::VARCHAR, conv_id::VARCHAR, turn::VARCHAR, text)) AS chunk_id
FROM conversations""")
def turn_ids(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    project = F.concat(F.lit("p"), F.col("conv_id") % 7)
    return turns.select(
        "conv_id", "turn", T.digest_with_nul(project, F.col("conv_id"), F.col("turn"), F.col("text")).alias("chunk_id")
    )


_LITTLE = "'0x' || " + " || ".join(f"substr(h, {2 * i + 1}, 2)" for i in range(7, -1, -1))


@query(f"""
SELECT doc_id, (({_LITTLE})::UBIGINT & 9223372036854775807::UBIGINT)::BIGINT AS vector_id
FROM (SELECT doc_id, md5('chunk-' || doc_id::VARCHAR || lang) AS h FROM documents)""")
def vector_ids(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", T.vector_id(F.concat(F.lit("chunk-"), "doc_id", "lang")).alias("vector_id"))


@query(f"""
SELECT conv_id, (({_LITTLE})::UBIGINT & 9223372036854775807::UBIGINT)::BIGINT AS snapshot_id
FROM (SELECT conv_id, sha256(concat_ws(chr(0), conv_id::VARCHAR, count(*)::VARCHAR)) AS h FROM conversations GROUP BY 1)""")
def snapshot_vector_ids(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return turns.select("conv_id", T.snapshot_vector_id(F.col("conv_id"), F.col("turns")).alias("snapshot_id"))


@query("""
SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens_up, (length(text) // 4)::BIGINT AS tokens_down,
  octet_length(encode(text))::BIGINT * 24 + 131072 AS store_bytes FROM documents""")
def size_estimates(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    c = F.col("text")
    return docs.select(
        "doc_id",
        T.tokens_up(c).alias("tokens_up"),
        T.tokens_down(c).alias("tokens_down"),
        T.store_bytes(c).alias("store_bytes"),
    )


@query(rf"""
WITH w AS (SELECT doc_id, list_transform({_WORDS}, lambda x: lower(x)) AS ws FROM documents),
c AS (SELECT doc_id, ws, list_filter(ws, lambda x: x NOT IN ({_STOP})) AS content FROM w),
u AS (SELECT doc_id, CASE WHEN len(content) > 0 THEN content ELSE ws END AS ws FROM c),
f AS (SELECT doc_id, word, min(pos) AS pos FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM u) GROUP BY 1, 2)
SELECT d.doc_id, coalesce(array_to_string(list_slice(list(word ORDER BY pos) FILTER (WHERE word IS NOT NULL), 1, 32), ' '), '') AS terms
FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""")
def lexical_terms(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(T.lexical_terms(F.col("text")), " ").alias("terms"))


@query(r"""
SELECT item_id, array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Pc}]+'), lambda w: '"' || w || '"'), ' OR ') AS expression
FROM benchmark""")
def match_expressions(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark")
    return items.select("item_id", T.match_expression(F.col("text")).alias("expression"))


@query(r"""
SELECT item_id, lower(trim(regexp_replace(text, '[\s\x0b\x85\p{Z}]+', ' ', 'g'))) || '|' || '8|true|' AS cache_key FROM benchmark""")
def cache_keys(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark")
    key = T.cache_key(F.col("text"), F.lit(8), F.lit(True), F.lit(None).cast("string"))
    return items.select("item_id", key.alias("cache_key"))


@query(r"""
WITH n AS (SELECT conv_id, turn, rtrim(trim(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x1f\x7f]', ' ', 'g'),
  '[\s\x0b\x85\p{Z}]+', ' ', 'g')), ' "''`*#_-:.…'), ' !?;,') AS name FROM conversations)
SELECT conv_id, turn, trim(CASE WHEN length(name) <= 60 THEN name
  WHEN regexp_replace(left(name, 60), ' [^ ]*$', '') <> '' THEN regexp_replace(left(name, 60), ' [^ ]*$', '')
  ELSE left(name, 60) END) AS name FROM n""")
def clean_names(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", T.clean_name(F.col("text")).alias("name"))


@query(r"""
SELECT page_id, array_to_string(regexp_extract_all(translate(lower(url_decode(
  coalesce(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), ''))), '_-', '  '), '[\p{L}\p{M}\p{Nd}\p{Pc}]+'), ' ') AS words FROM pages""")
def path_words(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", F.array_join(T.path_words(F.col("url")), " ").alias("words"))


@query(r"""
SELECT conv_id, turn, CASE WHEN length(text) > 120
  THEN regexp_replace(left(text, 120), '[\s\x0b\x85\p{Z}]+$', '') || '…[truncated]' ELSE text END AS shown FROM conversations""")
def truncated_turns(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", T.truncated(F.col("text"), 120).alias("shown"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS stamp,
  replace(replace(base64(encode('["' || ts::VARCHAR || '","' || event_id::VARCHAR || '"]')), '+', '-'), '/', '_') AS cursor
FROM events""")
def event_cursors(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return events.select(
        "event_id", T.iso_utc(F.col("ts")).alias("stamp"), T.page_cursor(F.col("ts"), F.col("event_id")).alias("cursor")
    )


@query(r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
x AS (SELECT doc_id, pos, regexp_replace(raw, '^[\s\x0b\x85\p{Z}]+|[\s\x0b\x85\p{Z}]+$', '', 'g') AS line FROM lines),
k AS (SELECT doc_id, pos::INTEGER AS pos, line, CASE WHEN line = '' OR length(line) > 80 THEN NULL
  WHEN regexp_matches(line, '^#{1,6}\s+\S.*$') THEN 'atx'
  WHEN regexp_matches(line, '^([0-9]+(\.[0-9]+)+|[0-9]+[.)])\s+[A-Z]\S*') AND NOT regexp_matches(line, '[.,;:!?]$') THEN 'numbered'
  WHEN regexp_matches(line, '[A-Z]') AND NOT regexp_matches(line, '[a-z]') AND len(string_split(regexp_replace(line, '[\s\x0b\x85\p{Z}]+', ' ', 'g'), ' ')) <= 12
    AND length(regexp_replace(line, '[^\p{L}]', '', 'g')) >= 3
    AND length(regexp_replace(line, '[^\p{L}]', '', 'g')) * 2 >= length(regexp_replace(line, '[\s\x0b\x85\p{Z}]', '', 'g')) THEN 'capitals' END AS kind FROM x)
SELECT doc_id, pos, kind, line FROM k WHERE kind IS NOT NULL""")
def heading_lines(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    lines = lines.select("doc_id", "pos", T.is_heading(F.col("raw")).alias("kind"), T.strip_white(F.col("raw")).alias("line"))
    return lines.where(F.col("kind").isNotNull())


@query("""
SELECT conv_id, string_agg(upper(left(role, 1)) || substr(lower(role), 2) || ': ' || text, chr(10) ORDER BY turn) AS transcript
FROM conversations GROUP BY 1""")
def transcripts(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    said = F.struct("turn", F.concat(F.initcap("role"), F.lit(": "), "text").alias("line"))
    lines = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("said"))
    return lines.select("conv_id", F.array_join("said.line", "\n").alias("transcript"))


@query("""
SELECT conv_id, turn, lower(trim(role)) AS role,
  lower(trim(role)) IN ('user', 'assistant', 'system') AND trim(text) <> '' AS valid FROM conversations""")
def valid_turns(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    role = F.lower(F.trim("role"))
    valid = role.isin("user", "assistant", "system") & (T.fold_white(F.col("text")) != "")
    return turns.select("conv_id", "turn", role.alias("role"), valid.alias("valid"))


@query("""
SELECT doc_id, CAST((pos * 256) AS INTEGER) AS start, substr(text, pos * 256 + 1, 276) AS chunk
FROM (SELECT doc_id, text, unnest(range((length(text) + 255) // 256)) AS pos FROM documents)""")
def fixed_batches(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("length(text) > 0")
    starts = docs.select("doc_id", "text", F.explode(F.expr("sequence(0, length(text) - 1, 256)")).alias("start"))
    return starts.select("doc_id", "start", F.expr("substring(text, start + 1, 276)").alias("chunk"))
