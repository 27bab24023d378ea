"""Finding and gating new material: sitemaps, relevance, routing, listings, citations, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespring.functions import text as T
from lorespring.operators.jobs import trimmed
from lorespring.operators.steps import Rounds, discard, written

# Words that a title leaves out.
FILLER = (
    "a an and are as at be can could describe difference do does explain for give help how i in is it me my of on please "
    "should tell the their them they this to use what when where which who why with would you your between about work works"
).split()


def sitemap_urls(files: DataFrame) -> DataFrame:
    """(host, pos, url) of the locations in sitemaps (host, text) that lie on their own host, each once."""
    found = F.regexp_extract_all("text", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"))
    urls = files.select("host", F.posexplode(found).alias("pos", "raw"))
    urls = urls.select("host", "pos", T.unescape_xml(F.col("raw")).alias("url"))
    urls = urls.where(F.lower(F.try_parse_url("url", F.lit("HOST"))) == F.lower("host"))
    return urls.groupBy("host", "url").agg(F.min("pos").alias("pos")).select("host", "pos", "url")


def path_matches(urls: DataFrame, tokens: DataFrame, limit: int | None = None) -> DataFrame:
    """URLs (id, url) ranked for each query by the idf of its tokens (query_id, token) that begin a word of the path.

    Words are joined to tokens through their first three letters, which every token has, so nothing is crossed. Ties
    go to the shorter URL, then by URL.
    """
    total = urls.agg(F.count("*").alias("n"))
    words = urls.select("id", "url", F.explode(F.array_distinct(T.path_words(F.col("url")))).alias("word"))
    head = F.substring("word", 1, 3).alias("head")
    asked = tokens.where(F.length("token") >= 3).select("query_id", "token", F.substring("token", 1, 3).alias("head")).distinct()
    hits = words.select("id", "url", "word", head).join(asked, "head").where(F.col("word").startswith(F.col("token")))
    hits = hits.select("query_id", "token", "id", "url").distinct()
    df = hits.groupBy("query_id", "token").agg(F.count_distinct("id").alias("df"))
    scored = hits.join(df, ["query_id", "token"]).join(F.broadcast(total))
    scored = scored.withColumn("idf", F.log((1 + F.col("n")) / (1.0 + F.col("df"))))
    out = scored.groupBy("query_id", "id", "url").agg(F.round(F.sum("idf"), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.length("url"), "url", "id")
    out = out.withColumn("rank", F.row_number().over(order))
    return out if limit is None else out.where(F.col("rank") <= limit)


def relevant(candidates: DataFrame, floor: float, most: int) -> DataFrame:
    """Of (query_id, pos, topic_score, subtopic_scores, query_score) those on the topic and on any subtopic, the best
    few by query score, in their first order."""
    gate = (F.col("topic_score") >= floor) & (
        (F.size("subtopic_scores") == 0) | F.exists("subtopic_scores", lambda s: s >= floor)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("query_score"), "pos")
    out = candidates.where(gate).withColumn("nth", F.row_number().over(order))
    return out.where(F.col("nth") <= most).drop("nth")


def routed(latest: DataFrame, history: DataFrame, floor: float = 0.35) -> DataFrame:
    """Each query's project: the best latest snapshot at the floor, else the best of all, else none.

    Both tables have (query_id, project, score); ties go to the earlier project.
    """

    def best(df: DataFrame, stage: str) -> DataFrame:
        order = F.struct("score", (-F.col("project")).alias("p"))
        top = df.where(F.col("score") >= floor).groupBy("query_id").agg(F.max(order).alias("b"))
        return top.select("query_id", (-F.col("b.p")).alias(f"project_{stage}"), F.col("b.score").alias(f"score_{stage}"))

    out = latest.unionByName(history).select("query_id").distinct()
    out = out.join(best(latest, "latest"), "query_id", "left").join(best(history, "history"), "query_id", "left")
    stage = F.when(F.col("project_latest").isNotNull(), "latest").when(F.col("project_history").isNotNull(), "history")
    return out.select(
        "query_id",
        F.coalesce("project_latest", "project_history").alias("project"),
        F.coalesce("score_latest", "score_history").alias("score"),
        F.coalesce(stage, F.lit("none")).alias("stage"),
    )


def citations(text: Column, known: Column) -> Column:
    """The references of a text, such as M1, in order and once: those that are known and those that aren't."""
    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][0-9]{1,3})\b")))
    return F.struct(F.array_intersect(refs, known).alias("known"), F.array_except(refs, known).alias("unknown"))


def dataset_listing(files: DataFrame) -> DataFrame:
    """(source, pos, name, licence, bytes) of listings (source, text), a list or an object with one; rows without a
    name are left out."""
    row = "array<struct<name:string,licence:string,license:string,bytes:long,size:long>>"
    held = F.coalesce(F.get_json_object("text", "$.datasets"), F.col("text"))
    rows = files.select("source", F.posexplode(F.from_json(held, row)).alias("pos", "d"))
    return rows.where(F.trim("d.name") != "").select(
        "source", "pos", "d.name", F.coalesce("d.licence", "d.license").alias("licence"), F.coalesce("d.bytes", "d.size").alias("bytes")
    )


def fallback_title(query: Column, most: int = 5) -> Column:
    """A title of a query's own content words, capitalised unless they have capitals of their own."""
    words = F.regexp_extract_all(query, F.lit(r"([A-Za-z0-9][\p{L}\p{N}_+#.\-]*)"))
    words = F.transform(words, lambda w: F.rtrim(w, F.lit(".-")))
    words = F.slice(F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(FILLER)), 1, most)
    kept = lambda w: F.regexp_like(F.substring(w, 2, 1000), F.lit(r"\p{Lu}")) | (F.upper(w) == w)
    words = F.transform(words, lambda w: F.when(kept(w), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1000)))))
    name = T.clean_name(F.array_join(words, " "))
    return F.when(name == "", "Untitled Conversation").otherwise(name)


def merged_by_url(chunks: DataFrame) -> DataFrame:
    """Chunks (url, pos, text) as one text a URL: each distinct text once, at its first place."""
    first = chunks.groupBy("url", "text").agg(F.min("pos").alias("pos"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return first.groupBy("url").agg(parts.alias("parts")).select("url", F.array_join("parts.text", "\n\n").alias("text"))


def relabelled(labels: DataFrame, model: str) -> DataFrame:
    """One label a chunk: the configured model's first, then the oldest."""
    order = Window.partitionBy("chunk_id").orderBy((F.col("model") != model).cast("int"), "label")
    return labels.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def answered_once(log: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (exchange_id, response) to a log (exchange_id, response) with what becomes of each."""
    both = answers.alias("a").join(log.alias("l"), "exchange_id", "left")
    found = F.col("l.known").isNotNull()
    state = F.when(~found, "not found").when(F.col("l.response").isNotNull(), "already answered").otherwise("recorded")
    return both.select("exchange_id", F.coalesce("l.response", F.when(found, F.col("a.response"))).alias("response"), state.alias("state"))


def levels(jobs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs (id) with the level each can run at, given edges (id, needs), and those that a cycle or an unknown need holds."""
    placed = trimmed(jobs, edges.join(jobs, "id", "left_semi").select("id", "needs").distinct())
    return placed.rows(), jobs.join(placed.rows().select("id"), "id", "left_anti")


def dependents(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root, depth): what depends on each root, however far, given edges (id, needs); a root is its own at depth 0.

    Each round takes one more step from what the last one reached first, so cycles end and chains may be of any length;
    it writes only what it reaches first.
    """
    reached, depth = Rounds(edges.sparkSession, "reached"), 0
    edges = written(edges, "edges")
    front = reached.add(roots.select("id", F.col("id").alias("root"), F.lit(0).alias("depth")))
    while not front.isEmpty():
        depth += 1
        after = front.select(F.col("id").alias("needs"), "root").join(edges, "needs").select("id", "root").distinct()
        front = reached.add(after.join(reached.rows(), ["id", "root"], "left_anti").withColumn("depth", F.lit(depth)))
    discard(edges)
    return reached.rows()
