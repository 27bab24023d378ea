"""Vector and lexical search, fusion, and what becomes of a ranking. Queries are all rows whose id 20 divides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespring.functions import text as T
from lorespring.operators import lexical, retrieval, vectors
from lorespring.plans.registry import query, read

K = 10


def vector_rows(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark, sf_dir) -> DataFrame:
    rows = vector_rows(spark, sf_dir).where("id % 20 = 0")
    return rows.select(F.col("id").alias("query_id"), "vector", "label")


def text_rows(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def text_queries(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_Q = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label FROM embeddings WHERE vec_id % 20 = 0"
_COS = f"""pairs AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score
  FROM ({_Q}) CROSS JOIN embeddings)"""
_DENSE = f"""{_COS}, dense AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank
  FROM pairs QUALIFY rank <= {K})"""


def dense(spark, sf_dir, k: int = K) -> DataFrame:
    """Scores are rounded before they are ranked, so that equal vectors tie."""
    scores = lambda q, r: vectors.cosine_scores(q, r).round(6)
    return vectors.nearest(vector_queries(spark, sf_dir), vector_rows(spark, sf_dir), k, scores)


@query(f"WITH {_DENSE} SELECT * FROM dense")
def cosine_top_k(spark, sf_dir):
    return dense(spark, sf_dir)


@query(f"""
WITH pairs AS (SELECT query_id, vec_id AS id, round(list_sum(list_transform(list_zip(q, embedding::DOUBLE[]), lambda p: (p[1] - p[2]) ** 2)), 6) AS score
  FROM ({_Q}) CROSS JOIN embeddings)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, id)::INTEGER AS rank FROM pairs QUALIFY rank <= {K}""")
def l2_top_k(spark, sf_dir):
    scores = lambda q, r: vectors.l2_scores(q, r).round(6)
    return vectors.nearest(vector_queries(spark, sf_dir), vector_rows(spark, sf_dir), K, scores, descending=False)


@query(f"WITH {_DENSE} SELECT * FROM dense")
def base_and_recent_merged(spark, sf_dir):
    """A search over what an index holds up to its watermark and over what came later, each with its own best k, merged."""
    scores = lambda q, r: vectors.cosine_scores(q, r).round(6)
    rows, queries = vector_rows(spark, sf_dir), vector_queries(spark, sf_dir)
    through = rows.agg(F.expr("max(id) * 3 div 4")).first()[0]
    parts = [vectors.nearest(queries, part, K, scores).drop("rank") for part in (rows.where(F.col("id") <= through), rows.where(F.col("id") > through))]
    return vectors.ranked(parts[0].unionByName(parts[1]), ["query_id"], F.desc("score"), F.asc("id"), limit=K)


@query(f"""
WITH {_COS}, best AS (SELECT query_id, max(score) AS best, count(*) FILTER (WHERE score >= 0.35) AS supporting FROM pairs WHERE id <> query_id GROUP BY 1)
SELECT query_id, best, least(supporting, {K}) AS supporting,
  CASE WHEN best >= 0.6 THEN 'FULL' WHEN best >= 0.35 THEN 'PARTIAL' ELSE 'NONE' END AS verdict FROM best""")
def sufficiency_verdicts(spark, sf_dir):
    others = dense(spark, sf_dir, K + 1).where("id <> query_id")
    others = vectors.ranked(others.drop("rank"), ["query_id"], F.desc("score"), F.asc("id"), limit=K)
    best = others.groupBy("query_id").agg(
        F.max("score").alias("best"), F.count_if(F.col("score") >= vectors.PARTIAL).alias("supporting")
    )
    return best.withColumn("verdict", vectors.verdict(F.col("best")))


@query(f"""
WITH {_DENSE} SELECT query_id, id, rank, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
  ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS scaled
FROM dense WINDOW w AS (PARTITION BY query_id)""")
def scaled_scores(spark, sf_dir):
    scaled = F.round(vectors.min_max(F.col("score"), ["query_id"]), 6)
    return dense(spark, sf_dir).select("query_id", "id", "rank", scaled.alias("scaled"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_W = r"'[\p{L}\p{M}\p{Nd}\p{Pc}]+'"
_BM25 = rf"""
words AS (SELECT doc_id AS id, list_transform(regexp_extract_all(text, {_W}), lambda x: lower(x)) AS ws FROM documents),
q0 AS (SELECT item_id AS query_id, list_transform(regexp_extract_all(text, {_W}), lambda x: lower(x)) AS ws FROM benchmark),
q1 AS (SELECT query_id, ws, list_filter(ws, lambda x: x NOT IN ({_STOP})) AS content FROM q0),
q2 AS (SELECT query_id, w, min(p) AS p FROM (SELECT query_id, unnest(CASE WHEN len(content) > 0 THEN content ELSE ws END) AS w,
  unnest(range(len(CASE WHEN len(content) > 0 THEN content ELSE ws END))) AS p FROM q1) GROUP BY 1, 2),
asked AS (SELECT query_id, w AS term FROM q2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p) <= 32),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM words),
tf AS (SELECT id, any_value(length) AS length, term, count(*) AS tf FROM (SELECT id, len(ws) AS length, unnest(ws) AS term FROM words) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df, stats),
scored AS (SELECT query_id, id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score
  FROM asked JOIN tf USING (term) JOIN idf USING (term), stats GROUP BY 1, 2),
bm25 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, id)::INTEGER AS rank FROM scored QUALIFY rank <= {K})"""


@query(f"WITH {_BM25} SELECT * FROM bm25")
def bm25_top_k(spark, sf_dir):
    return lexical.bm25(text_rows(spark, sf_dir), text_queries(spark, sf_dir), K, most=None)


@query()
def bm25_stemmed(spark, sf_dir):
    return lexical.bm25(text_rows(spark, sf_dir), text_queries(spark, sf_dir), K, stemming=True, most=None)


@query(rf"""
SELECT term, count(*) AS df, round(ln((1 + (SELECT count(*) FROM pages)) / (1.0 + count(*))), 9) AS idf FROM (
  SELECT DISTINCT page_id, unnest(regexp_extract_all(translate(lower(url_decode(coalesce(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), ''))), '_-', '  '), {_W})) AS term
  FROM pages) GROUP BY 1""")
def path_word_frequencies(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    terms = pages.select(F.explode(F.array_distinct(T.path_words(F.col("url")))).alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    total = pages.agg(F.count("*").alias("n"))
    return df.join(F.broadcast(total)).select("term", "df", F.round(F.log((1 + F.col("n")) / (1.0 + F.col("df"))), 9).alias("idf"))


# The two lists that are fused: neighbours by cosine, and by distance within the query's label.
_LABEL = f"""near AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY
    round(list_sum(list_transform(list_zip(q, embedding::DOUBLE[]), lambda p: (p[1] - p[2]) ** 2)), 6), vec_id)::INTEGER AS rank
  FROM ({_Q}) x JOIN embeddings e ON x.label = e.label QUALIFY rank <= {K})"""
_LISTS = f"{_DENSE}, {_LABEL}, lists AS (SELECT query_id, 'a_cosine' AS list, id, rank FROM dense UNION ALL SELECT query_id, 'b_label' AS list, id, rank FROM near)"


def two_lists(spark, sf_dir) -> DataFrame:
    queries = vector_queries(spark, sf_dir)
    scores = lambda q, r: vectors.l2_scores(q, r).round(6)
    near = vectors.nearest(queries, vector_rows(spark, sf_dir), K, scores, descending=False, by="label")
    near = near.join(queries.select("query_id", F.col("label").cast("long").alias("label")), ["query_id", "label"])
    a = dense(spark, sf_dir).select("query_id", F.lit("a_cosine").alias("list"), "id", "rank")
    return a.unionByName(near.select("query_id", F.lit("b_label").alias("list"), "id", "rank"))


_FUSED = f"""{_LISTS}, sums AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, list_sort(list(DISTINCT list)) AS sources,
  min(struct_pack(l := list, r := rank)) AS seen FROM lists GROUP BY 1, 2),
fused AS (SELECT query_id, id, score, sources, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen)::INTEGER AS rank FROM sums)"""


@query(f"WITH {_FUSED} SELECT query_id, id, score, array_to_string(sources, ',') AS sources, rank FROM fused")
def reciprocal_rank_fusion(spark, sf_dir):
    return retrieval.fuse(two_lists(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


_HYDRATED = f"""{_FUSED}, passages AS (SELECT query_id, id, rank, score, source, text, length(text) // 4 AS cost FROM fused LEFT JOIN documents ON doc_id = id)"""


def passages(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return retrieval.hydrate(retrieval.fuse(two_lists(spark, sf_dir)), docs)


@query(f"""WITH {_HYDRATED} SELECT query_id, count(text) AS resolved, count(*) - count(text) AS missing,
  coalesce(sum(length(text)), 0)::BIGINT AS chars FROM passages GROUP BY 1""")
def hydrated(spark, sf_dir):
    found = passages(spark, sf_dir).groupBy("query_id").agg(
        F.count("text").alias("resolved"),
        F.count_if(F.col("text").isNull()).alias("missing"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"),
    )
    return found


_DEDUP = rf"""{_HYDRATED}, once AS (SELECT *, regexp_replace(trim(text), '[\s\x0b\x85\p{{Z}}]+', ' ', 'g') AS key FROM passages
  WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY rank) = 1),
dedup AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY rank) = 1)"""


def unique_passages(spark, sf_dir) -> DataFrame:
    return retrieval.deduplicated(passages(spark, sf_dir).where("text is not null"))


@query(f"WITH {_DEDUP} SELECT query_id, id, rank FROM dedup")
def deduplicated_passages(spark, sf_dir):
    return unique_passages(spark, sf_dir).select("query_id", "id", "rank")


_BUDGET = f"""{_DEDUP}, spent AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS spent FROM dedup),
fit AS (SELECT * FROM spent WHERE spent <= 2048)"""


@query(f"""WITH {_BUDGET} SELECT query_id, id, rank, spent,
  row_number() OVER (PARTITION BY query_id ORDER BY source, id, rank)::INTEGER AS reading_rank FROM fit""")
def assembled_context(spark, sf_dir):
    fit = retrieval.within_budget(unique_passages(spark, sf_dir), T.tokens_down(F.col("text")))
    fit = fit.withColumn("document_id", F.col("source")).withColumn("start", F.col("id"))
    return retrieval.reading_order(fit).select("query_id", "id", "rank", "spent", "reading_rank")


@query(f"""WITH {_DEDUP}, spent AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS spent,
  row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM dedup)
SELECT query_id, id, 'M' || rank AS ref, spent FROM spent WHERE spent <= 4000 OR nth = 1""")
def evidence_within_budget(spark, sf_dir):
    fit = retrieval.within_budget(unique_passages(spark, sf_dir), F.length("text"), 4000, keep_first=True)
    return retrieval.tagged(fit, "M").select("query_id", "id", "ref", "spent")


@query(f"""WITH {_LISTS}, ids AS (SELECT query_id, id, CASE list WHEN 'a_cosine' THEN 1 ELSE 2 END AS part, 1.0::DOUBLE / rank AS score FROM lists)
SELECT query_id, id, max(score) AS score, arg_min(part, (-score, part)) AS part FROM ids GROUP BY 1, 2""")
def best_of_sub_queries(spark, sf_dir):
    part = F.when(F.col("list") == "a_cosine", 1).otherwise(2)
    hits = two_lists(spark, sf_dir).select("query_id", "id", part.alias("part"), (1.0 / F.col("rank")).alias("score"))
    return retrieval.best_per_id(hits)


@query()
def diversified_passages(spark, sf_dir):
    """Maximal marginal relevance over each query's twenty nearest."""
    pool = dense(spark, sf_dir, 2 * K).join(vector_rows(spark, sf_dir).drop("label"), "id")
    return retrieval.diversified(pool, K)


_OWNERS = "owners AS (SELECT doc_id, source AS owner FROM documents WHERE source IN ('src0', 'src1', 'src2'))"


@query(f"""WITH {_OWNERS} SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM owners o WHERE o.doc_id = d.doc_id)
  OR EXISTS (SELECT 1 FROM owners o WHERE o.doc_id = d.doc_id AND o.owner = 'src1')""")
def visible_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    owners = docs.where("source in ('src0', 'src1', 'src2')").select("doc_id", F.col("source").alias("owner"))
    return retrieval.visible(docs.select("doc_id"), owners, "src1")


@query(f"""WITH {_COS}, others AS (SELECT query_id, label, max(score) AS score FROM pairs JOIN embeddings ON vec_id = id WHERE id <> query_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS n FROM others),
b AS (SELECT query_id, max(label) FILTER (WHERE n = 1) AS project, max(score) FILTER (WHERE n = 1) AS score, max(score) FILTER (WHERE n = 2) AS second FROM r GROUP BY 1)
SELECT query_id, project, score, round(score - coalesce(second, 0), 6) AS margin, score >= 0.35 AS exists,
  score >= 0.35 AND round(score - coalesce(second, 0), 6) < 0.05 AS ambiguous FROM b""")
def resolved_projects(spark, sf_dir):
    """The project (label) whose best vector is nearest to each query, and how far ahead it is."""
    queries, rows = vector_queries(spark, sf_dir), vector_rows(spark, sf_dir)
    scores = lambda q, r: vectors.cosine_scores(q, r).round(6)
    best = vectors.nearest(queries, rows, 2, scores, by="label").where("id <> query_id")
    best = best.groupBy("query_id", F.col("label").cast("int").alias("project")).agg(F.max("score").alias("score"))
    order = vectors.ranked(best, ["query_id"], F.desc("score"), F.asc("project"), limit=2)
    pair = order.groupBy("query_id").agg(
        F.max_by("project", -F.col("rank")).alias("project"),
        F.max("score").alias("score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
    )
    margin = F.round(F.col("score") - F.coalesce("second", F.lit(0)), 6)
    return pair.select(
        "query_id", "project", "score", margin.alias("margin"), (F.col("score") >= 0.35).alias("exists"),
        ((F.col("score") >= 0.35) & (margin < 0.05)).alias("ambiguous"),
    )
