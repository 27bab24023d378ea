"""Search pages, reading, gathering in rounds, imports, prefixes and joins of stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorespring.functions import text as T
from lorespring.operators import discovery, retrieval, screening, store
from lorespring.operators.steps import bounded_batches
from lorespring.operators.vectors import FULL, PARTIAL, cosine_scores, nearest
from lorespring.plans.registry import query, read

_PLAIN = ", ".join(f"'{w}'" for w in discovery.PLAIN_WORDS)


def _shown(name: str) -> str:
    out = name
    for tag in ("script", "style", "noscript", *discovery.CHROME):
        out = rf"regexp_replace({out}, '<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'gis')"
    return out


@query(rf"""
WITH w AS (SELECT item_id, list_concat(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+#]*'),
    list_transform(regexp_extract_all(lower(text), '[a-z0-9]+(?:[_-][a-z0-9]+)+'), lambda c: translate(c, '_-', ''))) AS l FROM benchmark),
e AS (SELECT item_id, unnest(l) AS w, generate_subscripts(l, 1) AS p FROM w),
k AS (SELECT item_id, w, min(p) AS p FROM e WHERE length(w) >= 3 AND w NOT IN ({_PLAIN}) AND NOT contains('www.example.com', w) GROUP BY 1, 2)
SELECT b.item_id, coalesce(string_agg(w, ' ' ORDER BY p), '') AS tokens FROM benchmark b LEFT JOIN k USING (item_id) GROUP BY 1""")
def search_tokens(spark, sf_dir):
    tokens = discovery.term_tokens(F.col("text"), F.lit("www.example.com"))
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(tokens, " ").alias("tokens"))


@query(rf"""
WITH s AS (SELECT page_id, html, {_shown("regexp_replace(html, '<!--.*?-->', '', 'gs')")} AS t FROM pages),
l AS (SELECT page_id, unnest(string_split_regex(replace(replace(replace(regexp_replace(t, '<[^>]*>', chr(10), 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\r\n|[\n\r]')) AS line,
  generate_subscripts(string_split_regex(replace(replace(replace(regexp_replace(t, '<[^>]*>', chr(10), 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\r\n|[\n\r]'), 1) AS p FROM s),
k AS (SELECT page_id, regexp_replace(line, '^[\s\x0b\x85\p{{Z}}]+|[\s\x0b\x85\p{{Z}}]+$', '', 'g') AS line, p FROM l)
SELECT page_id, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE line <> ''), '') AS text FROM k GROUP BY 1""")
def readable_pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", discovery.readable(F.col("html")).alias("text"))


@query("""
WITH r AS (SELECT p_brand, p_size, p_partkey, p_name || ' ' || p_type AS t, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS pos FROM part),
s AS (SELECT *, contains(lower(t), 'steel')::INTEGER + contains(lower(t), 'brushed')::INTEGER + contains(lower(t), 'small')::INTEGER AS score FROM r)
SELECT p_brand || '-' || p_size AS page_id, 'https://shop.example.com/parts/' || p_partkey AS link, score,
  row_number() OVER (PARTITION BY p_brand, p_size ORDER BY score DESC, pos)::INTEGER AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""")
def search_results(spark, sf_dir):
    """The links of search pages made from the parts, one for each brand and size, best match first."""
    item = F.concat(F.lit("<li><A class=x HREF='../parts/"), "p_partkey", F.lit("#top'>"), "p_name", F.lit("</A> <i>"), "p_type", F.lit("</i></li>"))
    parts = read(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("html")))).alias("l"))
    menu, others = '<nav><a href="/parts/1">steel</a></nav>', '<a href="/search?page=2">steel</a><a href="https://example.org/steel">steel</a><a href="http://shop.example.com/steel">s</a>'
    html = F.concat(F.lit(f"<html>{menu}{others}<ul>"), F.array_join("l.html", ""), F.lit("</ul>"))
    pages = parts.select(
        F.concat_ws("-", "p_brand", "p_size").alias("page_id"),
        F.lit("https://shop.example.com/find/all?q=steel").alias("url"),
        html.alias("html"),
        F.lit("How to use brushed small Steel for the shop").alias("terms"),
    )
    return discovery.result_links(pages)


@query(f"""
WITH c AS (SELECT q.vec_id AS query_id, 1 + d.vec_id % 5 AS round, d.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
u AS (SELECT c.*, r.rounds FROM c JOIN (VALUES (1), (2), (3)) r(rounds) ON c.round <= r.rounds WHERE score >= 0.0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, rounds ORDER BY score DESC, round, id) AS n FROM u QUALIFY n <= 12),
v AS (SELECT query_id, rounds, CASE WHEN max(score) >= {FULL} THEN 'FULL' WHEN max(score) >= {PARTIAL} THEN 'PARTIAL' ELSE 'NONE' END AS verdict FROM k GROUP BY 1, 2),
f AS (SELECT query_id, coalesce(min(rounds) FILTER (WHERE verdict = 'FULL'), max(rounds)) AS rounds FROM v GROUP BY 1)
SELECT k.query_id, k.id, k.rounds, v.verdict, v.verdict <> 'NONE' AS stored FROM k JOIN f USING (query_id, rounds) JOIN v USING (query_id, rounds)""")
def gathered_in_rounds(spark, sf_dir):
    """Of each round only the best twelve can be among the twelve kept, so the nearest of each round are what is gathered."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"), (1 + F.col("vec_id") % 5).alias("round"))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", "vector")
    near = nearest(
        asked, rows.where("round <= 3").withColumnRenamed("vec_id", "id"), 12, lambda q, r: cosine_scores(q, r).round(6),
        by="round", within="label", admits=lambda q, r: q["query_id"] != r["id"],
    )
    candidates = near.select("query_id", "round", "id", F.col("score").alias("topic_score"), F.col("score").alias("query_score"))
    return discovery.acquired(candidates, floor=0.0, most=12, on_partial=True).select("query_id", "id", "rounds", "verdict", "stored")


@query("""
WITH t(v) AS (SELECT DISTINCT event_type || CASE WHEN value > 50 THEN '; charset=utf-8' ELSE '' END FROM events), m(k, h) AS (VALUES ('click', ' Text/HTML'), ('view', 'application/json'), ('purchase', 'image/png'))
SELECT event_id, coalesce(lower(trim(split_part(h || CASE WHEN value > 50 THEN '; charset=utf-8' ELSE '' END, ';', 1))) IN ('text/html', 'application/json'), false) AS allowed
FROM events LEFT JOIN m ON k = event_type""")
def allowed_content(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", " Text/HTML").when(F.col("event_type") == "view", "application/json").when(F.col("event_type") == "purchase", "image/png")
    header = F.concat(kind, F.when(F.col("value") > 50, "; charset=utf-8").otherwise(""))
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(discovery.content_type_allowed(header), F.lit(False)).alias("allowed"))


@query(r"""
SELECT p_partkey, array_to_string(list_filter([p_brand, p_name, CASE WHEN p_size > 25 THEN p_type ELSE ' ' END, 'price'], lambda x: trim(x) <> ''), ' ') AS terms,
  'https://example.org/find?q=' || replace(url_encode(terms), '%20', '+') AS url FROM part""")
def search_addresses(spark, sf_dir):
    subtopics = F.array(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(" "))
    parts = read(spark, sf_dir, "part").withColumn("terms", discovery.target_terms(F.col("p_brand"), subtopics, F.lit("price")))
    return parts.select("p_partkey", "terms", discovery.search_url(F.lit("https://example.org/find?q={terms}"), F.col("terms")).alias("url"))


@query(r"""
WITH n AS (SELECT doc_id, nfc_normalize(text) AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, regexp_replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS t FROM n),
s AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM c)
SELECT doc_id, md5(regexp_replace(t, '^[\s\x0b\x85\p{Z}]+|[\s\x0b\x85\p{Z}]+$', '', 'g')) AS digest FROM s
WHERE regexp_replace(t, '^[\s\x0b\x85\p{Z}]+|[\s\x0b\x85\p{Z}]+$', '', 'g') <> ''""")
def cleaned_queries(spark, sf_dir):
    """Every text tidied as a query is; what is empty then is refused."""
    bounded_batches(spark, 4 << 20)
    cleaned = read(spark, sf_dir, "documents").select("doc_id", T.clean_query(F.col("text")).alias("t"))
    return cleaned.where(F.col("t").isNotNull()).select("doc_id", F.md5("t").alias("digest"))


@query(r"""
WITH n AS (SELECT page_id, trim(regexp_replace(regexp_extract(rtrim(url, '/'), '[^/]*$'), '[:*?"<>|\\]', '_', 'g'), ' .') AS n FROM pages WHERE url IS NOT NULL)
SELECT page_id, CASE WHEN n = '' THEN 'upload' ELSE n END AS name, lower(regexp_extract(n, '.\.([^.]+)$', 1)) AS extension FROM n""")
def safe_names(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").where("url is not null").withColumn("name", T.safe_filename(F.rtrim("url", F.lit("/"))))
    return pages.select("page_id", "name", T.extension(F.col("name")).alias("extension"))


@query("""SELECT item_id, length(text) * 4 // 4 AS request, length(text) * 4 // 3 AS results, length(text) * 4 // 5 AS evidence,
  length(text) * 4 // 6 AS history, length(text) * 4 // 24 AS summary FROM benchmark""")
def section_budgets(spark, sf_dir):
    shares = store.section_chars(F.length("text").cast("long"))
    return read(spark, sf_dir, "benchmark").select("item_id", *(c.alias(n) for n, c in shares.items()))


@query("""
WITH t AS (SELECT conv_id, turn, string_agg(coalesce(text, ''), ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS t FROM conversations),
p AS (SELECT conv_id, turn, string_split(t, ' ') AS w, lag(string_split(t, ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t),
i AS (SELECT conv_id, turn, w, before, unnest(range(1, least(len(w), len(before)) + 1)) AS i FROM p),
m AS (SELECT conv_id, turn, min(i) AS first FROM i WHERE w[i] <> before[i] GROUP BY 1, 2)
SELECT p.conv_id, p.turn, coalesce(m.first - 1, least(len(w), len(before)))::INTEGER AS shared, coalesce(m.first - 1, least(len(w), len(before))) >= 32 AS reused
FROM p LEFT JOIN m ON m.conv_id = p.conv_id AND m.turn = p.turn WHERE before IS NOT NULL""")
def reused_prefixes(spark, sf_dir):
    """How many words a prompt of three turns shares at its start with the one before it of its conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    said = F.collect_list(F.coalesce("text", F.lit(""))).over(order.rowsBetween(-2, 0))
    prompts = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.array_join(said, " "), " ").alias("w"))
    pairs = prompts.withColumn("before", F.lag("w").over(order)).where("before is not null")
    shared = store.common_prefix(F.col("w"), F.col("before"))
    return pairs.select("conv_id", "turn", shared.alias("shared"), (shared >= store.LEAST_PREFIX).alias("reused"))


_NAMES = """(SELECT c_custkey AS id, c_nationkey AS owner, c_acctbal >= 0 AS here,
  c_mktsegment || CASE WHEN c_acctbal > 9000 THEN '' WHEN c_acctbal % 10 < 5 THEN '' ELSE ' (' || (2 + c_custkey // 40)::VARCHAR || ')' END AS name FROM customer)"""


@query(rf"""
WITH n AS {_NAMES}, s AS (SELECT *, regexp_replace(name, ' \(\d+\)$', '') AS stem, CASE WHEN regexp_matches(name, ' \(\d+\)$') THEN regexp_extract(name, '\((\d+)\)$', 1)::BIGINT ELSE 1 END AS k FROM n),
fresh AS (SELECT *, row_number() OVER (PARTITION BY owner, stem, k ORDER BY id) = 1 AND NOT EXISTS (SELECT 1 FROM s o WHERE o.here AND o.owner = s.owner AND o.stem = s.stem AND o.k = s.k) AS keeps FROM s WHERE NOT here),
taken AS (SELECT owner, stem, list(DISTINCT k) AS t FROM (SELECT owner, stem, k FROM s WHERE here UNION ALL SELECT owner, stem, k FROM fresh WHERE keeps) GROUP BY 1, 2),
moved AS (SELECT f.*, row_number() OVER (PARTITION BY owner, stem ORDER BY id) AS nth FROM fresh f WHERE NOT keeps)
SELECT id, name AS given, name FROM fresh WHERE keeps UNION ALL
SELECT id, m.name AS given, m.stem || CASE WHEN NOT list_contains(t, 1) AND nth = 1 THEN '' ELSE ' (' || list_filter(range(2, 3000), lambda x: NOT list_contains(t, x))[nth - CASE WHEN list_contains(t, 1) THEN 0 ELSE 1 END]::VARCHAR || ')' END
FROM moved m JOIN taken USING (owner, stem)""")
def imported_names(spark, sf_dir):
    """Customers below zero brought over to those above, renamed where their name is taken."""
    number = F.concat(F.lit(" ("), (2 + F.expr("c_custkey div 40")).cast("string"), F.lit(")"))
    plain = (F.col("c_acctbal") > 9000) | (F.expr("c_acctbal % 10") < 5)
    rows = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner"), "c_acctbal", F.concat("c_mktsegment", F.when(plain, "").otherwise(number)).alias("name")
    )
    return store.imported(rows.where("c_acctbal >= 0").drop("c_acctbal"), rows.where("c_acctbal < 0").drop("c_acctbal")).select("id", "given", "name")


@query("""
WITH k AS (SELECT lower(c_mktsegment) AS key, min(c_mktsegment) AS name FROM customer GROUP BY 1)
SELECT p_partkey, coalesce(k.name, p_type) AS topic FROM part LEFT JOIN k ON key = lower(trim(CASE WHEN p_size > 25 THEN ' building' ELSE p_type END)) ORDER BY 1""".replace("coalesce(k.name, p_type)", "coalesce(k.name, trim(CASE WHEN p_size > 25 THEN ' building' ELSE p_type END))"))
def canonical_topics(spark, sf_dir):
    known = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"))
    told = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, " building").otherwise(F.col("p_type")).alias("topic"))
    return store.canonical(told, "topic", known)


@query("""SELECT c.conv_id, c.turn, e.vec_id FROM conversations c JOIN embeddings e ON e.vec_id = c.conv_id * 4 + c.turn""")
def turn_vectors(spark, sf_dir):
    """Turns with the vectors of their chunks."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("conv_id * 4 + turn").alias("vec_id"))
    return turns.join(read(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")


@query("""
SELECT c_mktsegment AS topic, c_custkey AS project, o_orderkey AS snapshot, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS place
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1""")
def topic_snapshots(spark, sf_dir):
    """The snapshots of each topic's projects in order, of one owner's (region's) projects."""
    projects = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), F.col("c_mktsegment").alias("topic"), F.col("c_nationkey").alias("n_nationkey"))
    owned = projects.join(F.broadcast(read(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey")), "n_nationkey").drop("n_nationkey")
    snapshots = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("snapshot"), "o_orderdate")
    return store.snapshot_history(snapshots, owned, "o_orderdate", "snapshot").select("topic", "project", "snapshot", "place")


@query("SELECT conv_id, arg_max(text, turn) AS summary, max(turn) AS turn FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY 1")
def latest_summaries(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null")
    return said.groupBy("conv_id").agg(F.max_by("text", "turn").alias("summary"), F.max("turn").alias("turn"))


@query("SELECT event_type, count(*) AS pending, count(*) >= 2000 OR event_type = 'click' AS due FROM events GROUP BY 1")
def rebuilds_due(spark, sf_dir):
    pending = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("pending"))
    return pending.withColumn("due", store.rebuild_due(F.col("pending"), F.col("event_type") == "click", 2000))


@query("""
SELECT vec_id, CASE WHEN label IS NULL THEN 'missing' WHEN label - 3 < 0 THEN 'malformed' END AS problem FROM embeddings""")
def vector_id_problems(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", store.vector_id_problem(F.col("label") - 3).alias("problem"))


@query("""
WITH r(reason, status, code) AS (VALUES ('the storage limit is reached', 'NOT_INGESTED', 'QUOTA_EXCEEDED'), ('vector store down', 'NOT_INGESTED', 'VECTOR_STORE_UNAVAILABLE'),
  ('no text', 'FAILED', 'NO_TEXT'), ('bad zip', 'FAILED', 'MALFORMED'))
SELECT p_partkey, status, code FROM part JOIN r ON reason = CASE WHEN p_size < 10 THEN 'the storage limit is reached' WHEN p_size < 20 THEN 'vector store down' WHEN p_size < 30 THEN 'no text' ELSE 'bad zip' END""")
def skip_reasons(spark, sf_dir):
    size = F.col("p_size")
    reason = F.when(size < 10, "the storage limit is reached").when(size < 20, "vector store down").when(size < 30, "no text").otherwise("bad zip")
    return read(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in store.skip_reason(reason).items()))


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey)::INTEGER AS rank FROM orders o
WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def ready_queue(spark, sf_dir):
    """Open orders, as jobs, with no part of theirs outstanding, by priority and then in the order of the plan."""
    orders = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    blocked = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    ready = store.ready(orders, blocked, "o_orderkey", ["o_custkey"], F.asc("o_orderpriority"), F.asc("o_orderdate"), F.asc("o_orderkey"))
    return ready.select("o_custkey", "o_orderkey", "rank")


_HOSTS = "SELECT DISTINCT lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS host FROM pages WHERE url IS NOT NULL"


def _page_paths(spark, sf_dir):
    url = F.col("url")
    host, path = F.lower(F.regexp_extract(url, "^[^:]+://([^/?#:]*)", 1)), F.regexp_extract(url, "^[^:]+://[^/?#]*([^?#]*)", 1)
    return read(spark, sf_dir, "pages").where("url is not null").select(F.col("page_id").alias("id"), url, host.alias("host"), path.alias("path"))


@query(rf"""
WITH p AS (SELECT page_id AS id, lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM pages WHERE url IS NOT NULL),
r AS (SELECT id AS page_id, CASE WHEN host LIKE '%.org' THEN NOT starts_with(path, '/de/') WHEN host LIKE '%.com' THEN true ELSE false END AS ok, host, path FROM p)
SELECT CASE WHEN length(path) > 7 THEN 'long' ELSE 'short' END AS query_id, page_id AS id, row_number() OVER (PARTITION BY length(path) > 7 ORDER BY length(path), page_id)::INTEGER AS rank
FROM r WHERE ok QUALIFY rank <= 25""")
def permitted_links(spark, sf_dir):
    """Links by the length of their path, but only what the robots files of their hosts, as they were fetched, allow."""
    pages = _page_paths(spark, sf_dir)
    status = F.when(F.col("host").endswith(".org"), 200).when(F.col("host").endswith(".com"), 404).otherwise(503)
    files = pages.select("host").distinct().select("host", status.alias("status"), F.lit("User-agent: *\nDisallow: /de/").alias("text"))
    links = pages.select(F.when(F.length("path") > 7, "long").otherwise("short").alias("query_id"), "id", "host", "path", F.length("path").alias("rank"))
    rules = screening.robots_rules(screening.robots_by_status(files))
    return discovery.permitted(links, rules, 25).select("query_id", "id", "rank")


@query("""
SELECT c_custkey, (CASE WHEN c_nationkey < 5 THEN '10.' WHEN c_nationkey < 10 THEN '192.168.' WHEN c_nationkey < 15 THEN '172.' ELSE '8.8.' END
  || CASE WHEN c_nationkey < 5 THEN c_nationkey || '.1' WHEN c_nationkey < 15 AND c_nationkey >= 10 THEN (c_nationkey + 5)::VARCHAR || '.0' ELSE c_nationkey::VARCHAR END || '.7') AS host,
  c_nationkey < 10 OR c_nationkey BETWEEN 11 AND 14 AS private FROM customer""")
def private_hosts(spark, sf_dir):
    n = F.col("c_nationkey")
    text = n.cast("string")
    host = F.when(n < 5, F.concat(F.lit("10."), text, F.lit(".1.7"))).when(n < 10, F.concat(F.lit("192.168."), text, F.lit(".7")))
    host = host.when(n < 15, F.concat(F.lit("172."), (n + 5).cast("string"), F.lit(".0.7"))).otherwise(F.concat(F.lit("8.8."), text, F.lit(".7")))
    return read(spark, sf_dir, "customer").select("c_custkey", host.alias("host"), screening.private_address(host).alias("private"))


@query(f"""
WITH h AS ({_HOSTS}), n AS (SELECT host, row_number() OVER (ORDER BY host) AS p FROM h)
SELECT 'https://' || host || '/map.xml' AS url, (p - 1)::INTEGER AS pos FROM n WHERE p <= 10""")
def indexed_sitemaps(spark, sf_dir):
    """An index of all hosts' sitemaps, followed one level: the ten that it names first."""
    files = _page_paths(spark, sf_dir).select(F.concat(F.lit("https://"), "host", F.lit("/map.xml")).alias("url"), F.lit("<urlset/>").alias("text")).distinct()
    named = files.agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("<sitemap><loc> "), "url", F.lit("</loc></sitemap>")))), "").alias("l"))
    index = named.select(F.lit("https://index.example.com/").alias("url"), F.concat(F.lit("<sitemapindex>"), "l").alias("text"))
    return discovery.indexed_sitemaps(files.unionByName(index)).select("url", "pos")


@query("""
WITH t AS (SELECT n_nationkey AS target, c_mktsegment AS source, c_custkey AS link, CASE WHEN c_acctbal > 9000 THEN 1 WHEN c_acctbal > 7000 THEN 2 WHEN c_acctbal > 0 THEN 3 END AS tier
  FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT target, source, link, tier FROM t WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY target, source)""")
def discovered_links(spark, sf_dir):
    """Customers as links that a search, a search by keywords or a sitemap finds, by what they hold."""
    found = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("target"), F.col("c_mktsegment").alias("source"), F.col("c_custkey").alias("link"), "c_acctbal")
    tiers = ("c_acctbal > 9000", "c_acctbal > 7000 and c_acctbal <= 9000", "c_acctbal > 0 and c_acctbal <= 7000")
    return discovery.first_tier(*(found.where(t).drop("c_acctbal") for t in tiers))


@query("""
WITH p AS (SELECT l_orderkey AS query_id, l_linenumber AS id, l_extendedprice AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank,
    count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS same, CASE WHEN l_quantity > 48 THEN NULL ELSE l_discount END AS new FROM lineitem),
u AS (SELECT *, count(*) OVER (PARTITION BY query_id) > 1 AND count(*) FILTER (WHERE new IS NULL) OVER (PARTITION BY query_id) = 0 AS usable FROM p WHERE same = 1)
SELECT query_id, id, CASE WHEN usable THEN new ELSE score END AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN usable THEN -new END, rank, id)::INTEGER AS rank FROM u""")
def reranked_passages(spark, sf_dir):
    """Lines of orders as passages, scored anew by their discount; where a score is missing the order stays."""
    same = Window.partitionBy("l_orderkey", "l_linenumber")
    lines = read(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    lines = lines.withColumn("same", F.count("*").over(same)).where("same = 1")
    passages = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("id"), F.col("l_extendedprice").alias("score"), "rank")
    scores = lines.where("l_quantity <= 48").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("id"), F.col("l_discount").alias("new_score"))
    return retrieval.reranked(passages, scores)


@query("""
WITH h AS (SELECT o_custkey AS project, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT c_custkey AS project, c_nationkey AS advance, c_nationkey // 2 AS back FROM customer)
SELECT project, least(1 + coalesce(advance, 0), n)::BIGINT AS low, greatest(n - coalesce(back, 0), least(1 + coalesce(advance, 0), n))::BIGINT AS high FROM h LEFT JOIN m USING (project)""")
def snapshot_cursors(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    history = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.row_number().over(order).alias("place"))
    moves = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), F.col("c_nationkey").alias("advance"), F.expr("c_nationkey div 2").alias("back"))
    cursors = store.navigated(history, moves)
    return cursors.select("project", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


@query("""
SELECT conv_id, turn FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id
WHERE d.doc_id IS NULL OR d.source IS NULL OR d.source NOT IN ('src0', 'src2')""")
def visible_turns(spark, sf_dir):
    """Turns as chunks of the document of their conversation's number, as ``src1`` may see them."""
    docs = read(spark, sf_dir, "documents").where("source in ('src0', 'src1', 'src2')")
    owners = docs.select("doc_id", F.col("source").alias("owner"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("conv_id").alias("child"))
    parents = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("child"), "doc_id").distinct()
    return retrieval.visible_below(turns, parents, owners, "src1").select("conv_id", "turn")


@query("""
SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 'INGESTED' WHEN 'O' THEN 'NOT_INGESTED' ELSE 'FAILED' END AS status,
  o_orderstatus <> 'F' AS owner_removed, o_orderstatus <> 'F' AND NOT o_totalprice > 200000 AS file_removed FROM orders""")
def compensated_uploads(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "key")
    status = F.when(F.col("o_orderstatus") == "F", "INGESTED").otherwise("NOT_INGESTED")
    told = orders.where("o_orderstatus in ('F', 'O')").select("key", status.alias("status"))
    return store.compensated(orders.select("key", (F.col("o_totalprice") > 200000).alias("was_there")), told).drop("was_there")
