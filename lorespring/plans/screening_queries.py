"""Screening, quotas, mutations and audits over ``pages``, ``embeddings`` and the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespring.operators import acquisition, screening, tables
from lorespring.plans.registry import query, read


@query(r"""
SELECT page_id, starts_with(url, 'https://') AND regexp_matches('.' || lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '\.(example\.com|example\.org)$') AS trusted FROM pages""")
def trusted_hosts(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", screening.trusted(F.col("url"), ["example.com", "example.org"]).alias("trusted"))


# A robots file for each kind of host, made of the pages' own paths.
ROBOTS = "User-agent: *\nDisallow: /de/\nAllow: /de/1\nDisallow: /*html$\n# note\nUser-agent: bot\nDisallow: /\n"


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(pattern, allow, re) AS (VALUES ('/de/', false, '^/de/'), ('/de/1', true, '^/de/1'), ('/*html$', false, '^/.*html$')),
best AS (SELECT page_id, arg_max(allow, (length(pattern), allow)) AS said FROM p JOIN rules ON regexp_matches(path, re) GROUP BY 1)
SELECT p.page_id AS id, host, path, coalesce(said, true) AS allowed FROM p LEFT JOIN best USING (page_id)""")
def robots_allowed(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    urls = pages.select(F.col("page_id").alias("id"), F.parse_url("url", F.lit("HOST")).alias("host"), F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit("")).alias("path"))
    files = urls.select("host").distinct().withColumn("text", F.lit(ROBOTS))
    return screening.robots_allowed(urls, screening.robots_rules(files))


@query(r"""
SELECT page_id, unnest(l) AS href, unnest(range(len(l)))::INTEGER AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l FROM pages)""")
def page_links(spark, sf_dir):
    return screening.links(read(spark, sf_dir, "pages")).select("page_id", "href", "pos")


@query("""
SELECT p_partkey, CASE WHEN trim(p_type) = '' THEN 'licence missing' WHEN lower(trim(p_type)) NOT LIKE '%steel%' THEN 'licence not allowed'
  WHEN p_size IS NULL THEN 'size unknown' WHEN p_size > 25 THEN 'too big' END AS reason FROM part""")
def screened_datasets(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    licence = F.lower(F.trim("p_type"))
    allowed = part.select(licence.alias("licence")).where(F.contains("licence", F.lit("steel"))).distinct().withColumn("allowed", F.lit(True))
    looked_up = part.withColumn("licence", licence).join(allowed, "licence", "left")
    return looked_up.select("p_partkey", screening.dataset_verdict(F.col("p_type"), F.col("p_size"), F.col("allowed"), 25).alias("reason"))


@query("""
WITH s AS (SELECT ps.n_nationkey AS query_id, c_mktsegment AS id, round(avg(c_acctbal) / 10000, 12) AS score FROM customer JOIN nation ps ON c_nationkey = n_nationkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s)
SELECT query_id, id, score, rank FROM r WHERE rank = 1 OR (rank <= 3 AND score >= 0.45)""")
def selected_sources(spark, sf_dir):
    customers = read(spark, sf_dir, "customer")
    scored = customers.groupBy(F.col("c_nationkey").alias("query_id"), F.col("c_mktsegment").alias("id"))
    scored = scored.agg(F.round(F.avg("c_acctbal") / 10000, 12).alias("score"))
    return screening.selected(scored, 0.45)


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS spent FROM orders)
SELECT o_custkey, o_orderkey, round(spent, 2) AS spent, spent <= 500000 AS admitted FROM s""")
def quota_prefixes(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    out = screening.admitted(orders, F.col("o_totalprice"), 500000, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", F.round("spent", 2).alias("spent"), "admitted")


@query("""
WITH s AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1 AS remaining FROM events)
SELECT user_id, event_id FROM s WHERE remaining > 5""")
def evicted_events(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.lit(1).alias("size"))
    return screening.evicted(events, "size", 5, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("""
SELECT b.user_id, b.event_type, min(b.event_id) AS event_id FROM events b WHERE b.event_id % 7 > 0
  AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id % 7 = 0 AND e.user_id = b.user_id AND e.event_type = b.event_type) GROUP BY 1, 2""")
def inserted_or_ignored(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    old, batch = events.where("event_id % 7 = 0"), events.where("event_id % 7 > 0")
    return tables.new_rows(old, batch, ["user_id", "event_type"], F.asc("event_id"))


@query("""
WITH o AS (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier WHERE s_suppkey % 3 > 0), n AS (SELECT s_suppkey AS k, upper(s_name) AS name, s_acctbal + 1 AS bal FROM supplier WHERE s_suppkey % 3 < 2)
SELECT k, coalesce(o.name, n.name) AS name, coalesce(n.bal, o.bal) AS bal FROM o FULL JOIN n USING (k)""")
def upserted_suppliers(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    old = s.where(k % 3 > 0).select(k.alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    new = s.where(k % 3 < 2).select(k.alias("k"), F.upper("s_name").alias("name"), (F.col("s_acctbal") + 1).alias("bal"))
    return tables.upserted(old, new, ["k"], ["name"])


@query("""
WITH old AS (SELECT doc_id AS key, doc_id // 3 + 1 AS label FROM documents WHERE doc_id % 3 = 0), top AS (SELECT coalesce(max(label), 0) AS top FROM old)
SELECT key, label FROM old UNION ALL SELECT doc_id, top + row_number() OVER (ORDER BY doc_id) FROM documents, top WHERE doc_id % 3 > 0""")
def allocated_labels(spark, sf_dir):
    keys = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    old = keys.where("key % 3 = 0").select("key", F.expr("key div 3 + 1").alias("label"))
    return tables.labelled(old, keys, "key", "key").select("key", "label")


@query("""
SELECT 'chunk without label' AS check, doc_id::VARCHAR AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
UNION ALL SELECT 'label without chunk', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def label_audit(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id")
    key = F.col("doc_id").cast("string").alias("key")
    one = tables.orphans(docs, labels, "doc_id").select(F.lit("chunk without label").alias("check"), key)
    return one.unionByName(tables.orphans(labels, docs, "doc_id").select(F.lit("label without chunk").alias("check"), key))


@query("""
SELECT 'role' AS check, conv_id || ':' || turn AS key FROM conversations WHERE role NOT IN ('user', 'assistant')
UNION ALL SELECT 'length', conv_id || ':' || turn FROM conversations WHERE length(text) > 900
UNION ALL SELECT 'role repeats', conv_id || ':' || role FROM conversations GROUP BY conv_id, role HAVING count(*) > 3""")
def constraint_audit(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    roles = tables.failing(turns, "role", F.col("role").isin("user", "assistant"), "key")
    sizes = tables.failing(turns, "length", F.length("text") <= 900, "key")
    again = tables.repeated_keys(turns, ["conv_id", "role"]).where("rows > 3")
    again = again.select(F.lit("role repeats").alias("check"), F.concat_ws(":", "conv_id", "role").alias("key"))
    return roles.unionByName(sizes).unionByName(again)


@query("""
SELECT source AS store, count(*) AS texts, coalesce(sum(octet_length(encode(text))), 0)::BIGINT + 28 * count(*) AS bytes,
  ((coalesce(sum(octet_length(encode(text))), 0)::BIGINT + 28 * count(*)) * 100 // (SELECT sum(octet_length(encode(text))) + 28 * count(*) FROM documents))::BIGINT AS share
FROM documents GROUP BY 1""")
def storage_usage(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    used = docs.groupBy(F.col("source").alias("store")).agg(
        F.count("*").alias("texts"), (F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 28 * F.count("*")).alias("bytes")
    )
    total = used.agg(F.sum("bytes").alias("total"))
    return used.join(F.broadcast(total)).select("store", "texts", "bytes", F.expr("bytes * 100 div total").alias("share"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def event_properties(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""
WITH RECURSIVE up AS (SELECT n_nationkey AS id, n_nationkey AS root, 0 AS depth FROM nation WHERE n_nationkey % 5 = 0
  UNION ALL SELECT n.n_nationkey, up.root, up.depth + 1 FROM up JOIN nation n ON n.n_nationkey = up.id + 1 AND n.n_nationkey % 5 > 0)
SELECT id, root, depth FROM up""")
def transitive_dependents(spark, sf_dir):
    """Each job with what it depends on, however far: nations hang on the one before, every fifth on none."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    edges = nations.where("id % 5 > 0").select("id", (F.col("id") - 1).alias("needs"))
    return acquisition.dependents(edges, nations.where("id % 5 = 0"))
