"""Hybrid and turn search, provenance, snapshots, deletions, rollups and order of what is shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespring.operators import lexical, store
from lorespring.operators.vectors import ranked
from lorespring.plans import retrieval_queries as R
from lorespring.plans.registry import query, read

_DEEP = R._BM25.replace(f"rank <= {R.K}", f"rank <= {4 * R.K}")
_VECTORS = f"""dense AS (SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY
    round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id)::INTEGER AS rank
  FROM embeddings a JOIN benchmark ON item_id = a.vec_id CROSS JOIN embeddings b QUALIFY rank <= {4 * R.K})"""


_OWNED = "source IN ('src0', 'src2')"
_SHOWN = f"source IS NULL OR NOT ({_OWNED})"


def _hybrid_sql(deep: str, cosines: str, pool: int, seen: str) -> str:
    return rf"""WITH {deep}, {cosines},
lists AS (SELECT query_id, 'dense' AS list, id, rank FROM dense UNION ALL SELECT query_id, 'lexical', id, rank FROM bm25),
sums AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(struct_pack(l := list, r := rank)) AS seen FROM lists GROUP BY 1, 2),
pool AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS place FROM sums QUALIFY place <= {pool}),
seen AS (SELECT pool.*, text, regexp_replace(trim(text), '[\s\x0b\x85\p{{Z}}]+', ' ', 'g') AS key FROM pool JOIN documents ON doc_id = id
  WHERE text IS NOT NULL AND ({seen})),
once AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY place) = 1),
cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place)::INTEGER AS rank FROM once QUALIFY rank <= {R.K}),
fit AS (SELECT query_id, id, score, rank, sum(length(text) // 4) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS spent FROM cut)
SELECT * FROM fit WHERE spent <= 2048"""


def _hybrid(spark, sf_dir, below: bool):
    docs = read(spark, sf_dir, "documents")
    owners = docs.where("source in ('src0', 'src1', 'src2')").select("doc_id", F.col("source").alias("owner"))
    texts, vectors = R.text_queries(spark, sf_dir), R.vector_rows(spark, sf_dir)
    asked = vectors.join(texts.select(F.col("query_id").alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), "vector")
    return store.hybrid(R.text_rows(spark, sf_dir), vectors, texts, asked, R.K, owners, "src1", below)


@query(_hybrid_sql(_DEEP.replace(f"rank <= {4 * R.K}", f"rank <= {8 * R.K}"), _VECTORS.replace(f"rank <= {4 * R.K}", f"rank <= {8 * R.K}"), 8 * R.K, _SHOWN))
def hybrid_context(spark, sf_dir):
    """Each benchmark text with the vector of its number: dense and BM25 fused, seen by ``src1``, within the budget."""
    return _hybrid(spark, sf_dir, below=False)


_HIDDEN = f"(SELECT doc_id FROM documents WHERE {_OWNED})"


@query(_hybrid_sql(
    _DEEP.replace("FROM scored QUALIFY", f"FROM scored WHERE id NOT IN {_HIDDEN} QUALIFY"),
    _VECTORS.replace("CROSS JOIN embeddings b", f"CROSS JOIN (SELECT * FROM embeddings WHERE vec_id NOT IN {_HIDDEN}) b"), 4 * R.K, "true"))
def hybrid_context_below_access(spark, sf_dir):
    """``hybrid_context`` with access as part of both searches."""
    return _hybrid(spark, sf_dir, below=True)


_TURNS = "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations WHERE role <> 'system')"


@query(rf"""WITH {R._BM25.replace("FROM documents)", f"FROM {_TURNS})")}
SELECT query_id, conv_id, turn, role, score, rank FROM bm25 JOIN conversations ON conv_id * 1000 + turn = id""")
def turn_search(spark, sf_dir):
    """Turns in scope (user and assistant) by BM25, joined to their rows."""
    turns = read(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("id", F.expr("conv_id * 1000 + turn"))
    hits = lexical.bm25(turns.select("id", "text"), R.text_queries(spark, sf_dir), R.K)
    return hits.join(turns, "id").select("query_id", "conv_id", "turn", "role", "score", "rank")


@query("SELECT doc_id, source, coalesce(url, doc_id::VARCHAR) AS url FROM documents LEFT JOIN (SELECT page_id, min(url) AS url FROM pages GROUP BY 1) ON page_id = doc_id")
def document_provenance(spark, sf_dir):
    urls = read(spark, sf_dir, "pages").groupBy(F.col("page_id").alias("doc_id")).agg(F.min("url").alias("url"))
    return store.provenance(read(spark, sf_dir, "documents").select("doc_id", "source"), urls, "doc_id")


@query("""
WITH s AS (SELECT label AS project, vec_id AS id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place,
    count(*) OVER (PARTITION BY label) - 1 AS last FROM embeddings WHERE label IS NOT NULL),
p AS (SELECT q.id AS query_id, s.id, s.place, round(list_cosine_similarity(q.embedding::DOUBLE[], s.embedding::DOUBLE[]), 6) AS score,
    s.place - q.place // 2 AS l, least(q.place + 9, q.last) - s.place AS r
  FROM s AS q JOIN s ON q.project = s.project AND s.place BETWEEN q.place // 2 AND q.place + 9 WHERE q.id % 20 = 0)
SELECT query_id, id, place, score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(l, r), l > r) = 1""")
def snapshot_between_cursors(spark, sf_dir):
    """Each label's vectors in order as snapshots of a project; a query looks from half its own place to nine beyond it."""
    rows = read(spark, sf_dir, "embeddings").where("label is not null")
    rows = rows.select(F.col("label").alias("project"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    placed = ranked(rows, ["project"], F.asc("id")).withColumn("place", F.col("rank") - 1).drop("rank")
    queries = placed.where("id % 20 = 0").select(
        F.col("id").alias("query_id"), "project", F.expr("place div 2").alias("low"), (F.col("place") + 9).alias("high"), "vector"
    )
    return store.best_between(queries, placed)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_snapshots(spark, sf_dir):
    """Each customer's newest order, as the latest snapshot of a project is found."""
    return store.latest(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
WITH m AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'system' GROUP BY 1)
SELECT c.conv_id, c.turn FROM conversations c LEFT JOIN m USING (conv_id) WHERE c.turn > coalesce(m.last, -1)""")
def summaries_to_roll_forward(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    marks = turns.where("role = 'system'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return store.rolled_forward(turns, marks, "conv_id", "turn").select("conv_id", "turn")


@query("""
WITH n AS (SELECT user_id, count(*) AS exchanges FROM events GROUP BY 1)
SELECT user_id, exchanges, CASE WHEN exchanges <= 6 THEN 0 ELSE ((exchanges - 6) // 3 + 1) * 3 END AS start FROM n""")
def history_windows(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("exchanges"))
    return counts.withColumn("start", store.history_start(F.col("exchanges"), 6))


@query("""
WITH e AS (SELECT l_orderkey AS query_id, 'M' || l_linenumber AS ref, l_extendedprice AS score, l_returnflag = 'R' AS cited FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1)
SELECT query_id, ref, cited, row_number() OVER (PARTITION BY query_id ORDER BY cited DESC, score DESC, ref)::INTEGER AS rank FROM e""")
def ordered_evidence(spark, sf_dir):
    lines = ranked(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], F.asc("l_partkey"), F.asc("l_suppkey"), limit=1)
    lines = lines.select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("M"), "l_linenumber").alias("ref"), F.col("l_extendedprice").alias("score"), "l_returnflag")
    cited = lines.where("l_returnflag = 'R'").select("query_id", "ref")
    return store.evidence_order(lines.drop("l_returnflag"), cited).select("query_id", "ref", "cited", "rank")


@query(r"""
WITH w AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS v, generate_subscripts(string_split(p_name || ' ' || p_type, ' '), 1) AS p FROM part),
f AS (SELECT p_partkey, arg_min(trim(v), p) AS v, min(p) AS p FROM w WHERE trim(v) <> '' GROUP BY p_partkey, lower(trim(v))),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY p) <= 4)
SELECT p_partkey, string_agg(v, '|' ORDER BY p) AS terms FROM k GROUP BY 1""")
def distinct_terms(spark, sf_dir):
    words = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(store.distinct_strings(words, 4), "|").alias("terms"))


@query(r"SELECT doc_id, source FROM documents WHERE source LIKE 'src1%' ESCAPE '\'")
def names_with_prefix(spark, sf_dir):
    """A prefix match; as no pattern is built, nothing in the prefix has to be escaped."""
    return read(spark, sf_dir, "documents").where(F.col("source").startswith("src1")).select("doc_id", "source")


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'f' ELSE 't' END AS is_active FROM customer")
def soft_deleted_customers(spark, sf_dir):
    table = read(spark, sf_dir, "customer").select("c_custkey", F.lit("t").alias("is_active"))
    keys = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return store.soft_deleted(table, keys, "c_custkey")


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def deleted_labels(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    return store.deleted(labels, labels.where("toxic = 1"), "doc_id").select("doc_id", "quality")


@query("""
SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS done, count(*) FILTER (WHERE l_returnflag = 'R') AS failed,
  CASE WHEN count(*) FILTER (WHERE l_returnflag <> 'R') = 0 THEN 'FAILED' WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status
FROM lineitem GROUP BY 1""")
def upload_outcomes(spark, sf_dir):
    sums = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") != "R").alias("done"), F.count_if(F.col("l_returnflag") == "R").alias("failed")
    )
    return sums.withColumn("status", store.outcome(F.col("done"), F.col("failed")))


@query("""
WITH t AS (SELECT user_id, event_type, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT user_id, arg_max(event_type, (round(total, 6), event_type)) AS slowest, round(sum(total), 6) AS total FROM t GROUP BY 1""")
def slowest_stages(spark, sf_dir):
    """Each user's event type with the largest total, as the slowest stage of a run is told."""
    totals = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("total"))
    return totals.groupBy("user_id").agg(
        F.max_by("event_type", F.struct(F.round("total", 6), "event_type")).alias("slowest"), F.round(F.sum("total"), 6).alias("total")
    )


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS hits, count(*) FILTER (WHERE event_type = 'click') AS misses,
  CASE WHEN count(*) FILTER (WHERE event_type IN ('view', 'click')) = 0 THEN 0.0
    ELSE round(count(*) FILTER (WHERE event_type = 'view') / count(*) FILTER (WHERE event_type IN ('view', 'click')), 6) END AS rate
FROM events GROUP BY 1""")
def hit_rates(spark, sf_dir):
    hits, misses = (F.count_if(F.col("event_type") == t).alias(n) for t, n in (("view", "hits"), ("click", "misses")))
    counts = read(spark, sf_dir, "events").groupBy("user_id").agg(hits, misses)
    both = F.col("hits") + F.col("misses")
    return counts.withColumn("rate", F.when(both == 0, 0.0).otherwise(F.round(F.col("hits") / both, 6)))


@query("SELECT event_type, date_part('hour', ts)::INTEGER AS level, count(*) AS tries FROM events GROUP BY 1, 2")
def retry_tallies(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("level")).agg(F.count("*").alias("tries"))


@query("""
SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM conversations) AS chunks""")
def corpus_totals(spark, sf_dir):
    one, *others = (read(spark, sf_dir, t).agg(F.count("*").alias(n)) for t, n in (("documents", "documents"), ("embeddings", "vectors"), ("conversations", "chunks")))
    for other in others:
        one = one.join(F.broadcast(other))
    return one


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def labelled_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").intersect(read(spark, sf_dir, "labels").select("doc_id"))


@query("""
WITH l AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'), p AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000),
u AS (SELECT * FROM l UNION ALL SELECT * FROM p WHERE c_custkey NOT IN (SELECT c_custkey FROM l))
SELECT c_custkey, c_acctbal FROM u""")
def merged_pages(spark, sf_dir):
    customers = read(spark, sf_dir, "customer")
    listed = customers.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal")
    page = customers.where("c_acctbal > 5000").select("c_custkey", "c_acctbal")
    return store.merged(listed, page, "c_custkey")


@query(rf"""WITH {R._BM25}
SELECT b.item_id AS query_id, coalesce(bool_or(contains(d.text, b.text)), false) AS found FROM benchmark b
LEFT JOIN bm25 h ON h.query_id = b.item_id AND h.rank <= 5 LEFT JOIN documents d ON d.doc_id = h.id GROUP BY 1""")
def corpus_hits(spark, sf_dir):
    """Whether one of the five best hits of a question holds its text, as a corpus is validated."""
    asked = R.text_queries(spark, sf_dir)
    hits = lexical.bm25(R.text_rows(spark, sf_dir), asked, 5).select("query_id", "id")
    both = hits.join(R.text_rows(spark, sf_dir).withColumnRenamed("text", "passage"), "id").join(asked, "query_id")
    found = both.groupBy("query_id").agg(F.bool_or(F.col("passage").contains(F.col("text"))).alias("found"))
    return asked.select("query_id").join(found, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
