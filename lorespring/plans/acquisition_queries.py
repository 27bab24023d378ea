"""Gates, routing, sitemaps, listings and citations over ``pages``, ``embeddings``, ``documents`` and ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespring.functions import text as T
from lorespring.operators import acquisition, vectors
from lorespring.plans.registry import query, read
from lorespring.plans.retrieval_queries import vector_queries, vector_rows

_PATH = r"translate(lower(url_decode(coalesce(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), ''))), '_-', '  ')"


@query("""
SELECT host, url, min(pos)::INTEGER AS pos FROM (
  SELECT lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS host, url,
    row_number() OVER (PARTITION BY lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) ORDER BY page_id) - 1 AS pos FROM pages) GROUP BY 1, 2""")
def sitemap_urls(spark, sf_dir):
    """Sitemaps written from the pages of each host, and read again."""
    pages = read(spark, sf_dir, "pages").withColumn("host", F.lower(F.parse_url("url", F.lit("HOST"))))
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    entry = F.concat(F.lit("<url><loc> "), escaped, F.lit(" </loc></url>"))
    maps = pages.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("entry")))).alias("rows"))
    return acquisition.sitemap_urls(maps.select("host", F.array_join("rows.entry", "\n").alias("text")))


@query(rf"""
WITH words AS (SELECT DISTINCT page_id AS id, url, unnest(regexp_extract_all({_PATH}, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+')) AS word FROM pages),
tokens(query_id, token) AS (VALUES (1, 'html'), (1, '100'), (2, '200'), (2, '12'), (3, '317'), (3, '742')),
hits AS (SELECT DISTINCT query_id, token, id, url FROM tokens JOIN words ON length(token) >= 3 AND starts_with(word, token)),
df AS (SELECT query_id, token, count(DISTINCT id) AS df FROM hits GROUP BY 1, 2),
s AS (SELECT query_id, id, url, round(sum(ln((1 + (SELECT count(*) FROM pages)) / (1.0 + df))), 9) AS score FROM hits JOIN df USING (query_id, token) GROUP BY 1, 2, 3)
SELECT query_id::BIGINT AS query_id, id, url, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(url), url, id)::INTEGER AS rank FROM s QUALIFY rank <= 20""")
def path_matches(spark, sf_dir):
    tokens = [(1, "html"), (1, "100"), (2, "200"), (2, "12"), (3, "317"), (3, "742")]
    urls = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return acquisition.path_matches(urls, spark.createDataFrame(tokens, "query_id long, token string"), 20)


_Q = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label FROM embeddings WHERE vec_id % 20 = 0"


@query(f"""
WITH p AS (SELECT query_id, vec_id AS pos, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS s FROM ({_Q}) CROSS JOIN embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos) AS n FROM p QUALIFY n <= 30),
g AS (SELECT query_id, pos, s AS query_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos) AS nth FROM r WHERE s >= 0.2 AND (s - 0.1 >= 0.2 OR s - 0.05 >= 0.2))
SELECT query_id, pos, query_score FROM g WHERE nth <= 5""")
def relevance_gate(spark, sf_dir):
    """Each query's thirty nearest through a gate on its topic and on either of two subtopics."""
    scores = lambda q, r: vectors.cosine_scores(q, r).round(6)
    near = vectors.nearest(vector_queries(spark, sf_dir), vector_rows(spark, sf_dir), 30, scores)
    score = F.col("score")
    near = near.select("query_id", F.col("id").alias("pos"), score.alias("topic_score"), F.array(score - 0.1, score - 0.05).alias("subtopic_scores"), score.alias("query_score"))
    return acquisition.relevant(near, 0.2, 5).select("query_id", "pos", "query_score")


_PARTS = """latest AS (SELECT p_size AS query_id, p_partkey % 7 AS project, round(p_retailprice / 4000, 6) AS score FROM part
  QUALIFY row_number() OVER (PARTITION BY p_size, p_partkey % 7 ORDER BY p_partkey DESC) = 1),
history AS (SELECT p_size AS query_id, p_partkey % 7 AS project, round(p_retailprice / 3000, 6) AS score FROM part)"""


@query(f"""
WITH {_PARTS},
l AS (SELECT query_id, project, score FROM latest WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, project) = 1),
h AS (SELECT query_id, project, score FROM history WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, project) = 1)
SELECT q.query_id, coalesce(l.project, h.project) AS project, coalesce(l.score, h.score) AS score,
  CASE WHEN l.project IS NOT NULL THEN 'latest' WHEN h.project IS NOT NULL THEN 'history' ELSE 'none' END AS stage
FROM (SELECT DISTINCT query_id FROM history) q LEFT JOIN l USING (query_id) LEFT JOIN h USING (query_id)""")
def routed_in_two_stages(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    project = (F.col("p_partkey") % 7).alias("project")
    at = lambda scale: F.round(F.col("p_retailprice") / scale, 6).alias("score")
    newest = vectors.ranked(part.withColumn("project", project), ["p_size", "project"], F.desc("p_partkey"), limit=1)
    latest = newest.select(F.col("p_size").alias("query_id"), "project", at(4000))
    return acquisition.routed(latest, part.select(F.col("p_size").alias("query_id"), project, at(3000)), 0.4)


@query(r"""
WITH t AS (SELECT p_partkey, 'see ' || p_brand || ' M' || p_size || ', G7 and M' || p_size || ' or Z9' AS text FROM part),
r AS (SELECT p_partkey, unnest(regexp_extract_all(text, '\b[A-Z][0-9]{1,3}\b')) AS ref, unnest(range(len(regexp_extract_all(text, '\b[A-Z][0-9]{1,3}\b')))) AS pos FROM t),
d AS (SELECT p_partkey, ref, min(pos) AS pos FROM r GROUP BY 1, 2)
SELECT p_partkey, coalesce(string_agg(ref, ',' ORDER BY pos) FILTER (WHERE ref IN ('M1', 'M2', 'M3', 'G7')), '') AS known,
  coalesce(string_agg(ref, ',' ORDER BY pos) FILTER (WHERE ref NOT IN ('M1', 'M2', 'M3', 'G7')), '') AS unknown FROM d GROUP BY 1""")
def cited_references(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    m = F.concat(F.lit(" M"), "p_size")
    text = F.concat(F.lit("see "), "p_brand", m, F.lit(", G7 and"), m, F.lit(" or Z9"))
    cited = acquisition.citations(text, F.array(*map(F.lit, ("M1", "M2", "M3", "G7"))))
    out = part.select("p_partkey", cited.alias("c"))
    return out.select("p_partkey", F.array_join("c.known", ",").alias("known"), F.array_join("c.unknown", ",").alias("unknown"))


@query("""
SELECT p_brand AS source, p_partkey AS key, p_name AS name, CASE WHEN p_size > 3 THEN p_type END AS licence, p_size::BIGINT AS bytes FROM part""")
def dataset_listings(spark, sf_dir):
    """Listings written from the parts of each brand, and read again."""
    part = read(spark, sf_dir, "part").withColumn("licence", F.when(F.col("p_size") > 3, F.col("p_type")))
    row = F.struct(F.concat_ws("|", "p_partkey", "p_name").alias("name"), "licence", F.col("p_size").alias("bytes"))
    lists = part.groupBy(F.col("p_brand").alias("source")).agg(F.to_json(F.struct(F.collect_list(row).alias("datasets"))).alias("text"))
    out = acquisition.dataset_listing(lists)
    key, name = F.substring_index("name", "|", 1).cast("long"), F.substring_index("name", "|", -1)
    return out.select("source", key.alias("key"), name.alias("name"), "licence", "bytes")


@query(r"""
WITH w AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][\p{L}\p{N}_+#.\-]*'), lambda x: rtrim(x, '.-')), lambda x: x <> '') AS ws FROM conversations),
k AS (SELECT conv_id, turn, list_slice(list_filter(ws, lambda x: NOT list_contains(string_split('__FILLER__', ' '), lower(x))), 1, 5) AS ws FROM w),
n AS (SELECT conv_id, turn, array_to_string(list_transform(ws, lambda x: CASE WHEN regexp_matches(substr(x, 2), '\p{Lu}') OR upper(x) = x THEN x ELSE upper(left(x, 1)) || lower(substr(x, 2)) END), ' ') AS name FROM k),
c AS (SELECT conv_id, turn, rtrim(trim(trim(name), ' "''`*#_-:.…'), ' !?;,') AS name FROM n)
SELECT conv_id, turn, CASE WHEN name = '' THEN 'Untitled Conversation' WHEN length(name) <= 60 THEN name
  WHEN regexp_replace(left(name, 60), ' [^ ]*$', '') <> '' THEN regexp_replace(left(name, 60), ' [^ ]*$', '') ELSE left(name, 60) END AS title FROM c""".replace("__FILLER__", " ".join(acquisition.FILLER)))
def fallback_titles(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", acquisition.fallback_title(F.col("text")).alias("title"))


@query("""
WITH d AS (SELECT role AS url, text, min(conv_id * 1000 + turn) AS pos FROM conversations GROUP BY 1, 2)
SELECT url, md5(string_agg(text, chr(10) || chr(10) ORDER BY pos, text)) AS digest, count(*) AS texts FROM d GROUP BY 1""")
def texts_by_url(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    chunks = turns.select(F.col("role").alias("url"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text")
    merged = acquisition.merged_by_url(chunks)
    counts = chunks.groupBy("url").agg(F.count_distinct("text").alias("texts"))
    return merged.join(counts, "url").select("url", F.md5("text").alias("digest"), "texts")


@query("""
SELECT o_custkey AS chunk_id, arg_min(o_orderkey, (o_orderstatus <> 'O', o_orderkey)) AS label FROM orders GROUP BY 1""")
def relabelled_chunks(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    labels = orders.select(F.col("o_custkey").alias("chunk_id"), F.col("o_orderkey").alias("label"), F.col("o_orderstatus").alias("model"))
    return acquisition.relabelled(labels, "O").select("chunk_id", "label")


@query("""
SELECT doc_id AS exchange_id, CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS response,
  CASE WHEN l.doc_id IS NULL THEN 'not found' WHEN l.doc_id % 2 = 0 THEN 'already answered' ELSE 'recorded' END AS state
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def answers_recorded_once(spark, sf_dir):
    log = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("exchange_id")).distinct()
    log = log.select("exchange_id", F.when(F.col("exchange_id") % 2 == 0, "old").alias("response"), F.lit(True).alias("known"))
    answers = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("exchange_id"), F.lit("new").alias("response"))
    return acquisition.answered_once(log, answers)


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS id, n_nationkey - 3 AS needs FROM nation WHERE n_nationkey >= 3 UNION ALL SELECT n_nationkey, n_nationkey - 5 FROM nation WHERE n_nationkey >= 5),
paths AS (SELECT n_nationkey AS id, 0 AS level FROM nation WHERE n_nationkey < 3 UNION SELECT e.id, paths.level + 1 FROM paths JOIN e ON e.needs = paths.id)
SELECT id, max(level) AS level FROM paths GROUP BY 1""")
def job_levels(spark, sf_dir):
    """When each nation's job can run if it needs those three and five before it."""
    jobs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    edges = [jobs.where(F.col("id") >= k).select("id", (F.col("id") - k).alias("needs")) for k in (3, 5)]
    return acquisition.levels(jobs, edges[0].unionByName(edges[1]))[0]
