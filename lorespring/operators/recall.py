"""Recall from conversation memory: turns searched within each query's scope, projects found by their snapshots, verdicts.

A scope is a project, or one conversation of it, less the current conversation's turns from a given one on. It is part
of both searches, so a turn out of scope never takes a place among the best; statistics of words are those of all turns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespring.functions import text as T
from lorespring.operators import lexical, retrieval
from lorespring.operators.steps import written
from lorespring.operators.vectors import MISSING, PARTIAL, Attributes, cosine, cosine_scores, nearest, ranked, verdict

#: Candidates of either search for each turn that is asked for.
POOL = 4
LATEST_FLOOR, HISTORY_FLOOR = 0.35, 0.35
_SCOPE, _PLACE = ["current", "only", "before"], ["conv_id", "turn"]


def _rounded(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return cosine_scores(queries, rows).round(6)


def admits(queries: Attributes, rows: Attributes) -> np.ndarray:
    """Which rows lie in the queries' scopes, within their projects."""
    own = queries["current"] == rows["conv_id"]
    late = own & (queries["before"] != MISSING) & (rows["turn"] >= queries["before"])
    return (own | (queries["only"] != 1)) & ~late


def admitted() -> Column:
    """``admits`` as a condition on columns."""
    own = F.coalesce(F.col("current") == F.col("conv_id"), F.lit(False))
    late = own & F.coalesce(F.col("turn") >= F.col("before"), F.lit(False))
    return (own | ~F.coalesce(F.col("only") == 1, F.lit(False))) & ~late


def local_candidates(queries: DataFrame, turns: DataFrame, vectors: DataFrame, pool: int) -> DataFrame:
    """(query_id, id, score, sources, rank): dense and lexical search in scope, each ``pool`` deep, fused.

    ``queries`` has (query_id, text, vector, project, current, only, before): ``only`` is 1 where just the current
    conversation is searched, ``before`` null where all of it is. ``turns`` has (id, project, conv_id, turn, text), and
    ``vectors`` (id, vector) for those turns that have one. A query without a project finds nothing.
    """
    scope = turns.select("id", "project", *_PLACE)
    near = nearest(
        queries, vectors.join(scope, "id"), pool, _rounded, within="project", admits=admits, query_columns=_SCOPE, row_columns=_PLACE
    )
    words = lexical.bm25(turns, queries, pool, within="project", admits=admitted(), query_columns=_SCOPE, row_columns=_PLACE)
    lists = [df.select("query_id", F.lit(name).alias("list"), "id", "rank") for df, name in ((near, "dense"), (words, "lexical"))]
    return retrieval.fuse(lists[0].unionByName(lists[1]), pool=pool)


def local_context(queries: DataFrame, turns: DataFrame, vectors: DataFrame, k: int, diverse: bool = False) -> DataFrame:
    """(query_id, id, conv_id, turn, score, rank, spent, reading_rank): the turns in scope that answer each query.

    Candidates without a text are dropped, repeated texts too, then the first ``k`` are kept, or with ``diverse`` the k
    that repeat each other least (turns without a vector count as like no other); what exceeds the token budget goes, and
    ``reading_rank`` is the order of the conversations.
    """
    found = local_candidates(queries, turns, vectors, POOL * k).drop("sources")
    found = found.join(turns.select("id", *_PLACE, "text"), "id").where(F.col("text").isNotNull())
    unique = retrieval.deduplicated(found)
    if diverse:
        width = vectors.agg(F.max(F.size("vector"))).first()[0] or 1
        held = unique.join(vectors, "id", "left").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), width)))
        chosen = retrieval.diversified(held.select("query_id", "id", "rank", "score", "vector"), k)
        first = unique.drop("rank").join(chosen, ["query_id", "id"])
    else:
        first = ranked(unique.withColumnRenamed("rank", "place"), ["query_id"], F.asc("place"), limit=k).drop("place")
    fit = retrieval.within_budget(first, T.tokens_down(F.col("text")))
    reading = ranked(fit.withColumnRenamed("rank", "place"), ["query_id"], F.asc("conv_id"), F.asc("turn"), F.asc("place"))
    return reading.select("query_id", "id", *_PLACE, "score", F.col("place").alias("rank"), "spent", F.col("rank").alias("reading_rank"))


def routed(
    queries: DataFrame, mapping: DataFrame, snapshots: DataFrame, summaries: DataFrame, latest_floor: float = LATEST_FLOOR, history_floor: float = HISTORY_FLOOR
) -> DataFrame:
    """(query_id, stage, project, score): where each query belongs.

    A query (query_id, current, topic, vector) whose conversation ``mapping`` (conv_id, project) knows goes there:
    stage known. Else the projects of its topic are asked, by their latest snapshot first, stage latest; where none
    reaches the floor by the best of all their snapshots, stage history. The project of the smallest number wins ties.
    ``snapshots`` has (topic, project, id, place, vector); a project without any is stood for by its summary (topic,
    project, id, vector). A query without a topic that has projects ends as no_topic, one that no project is near to as no_project.
    """
    known = queries.join(mapping.select(F.col("conv_id").alias("current"), "project").where("project is not null"), "current")
    known = known.select("query_id", F.lit("known").alias("stage"), F.col("project").cast("long").alias("project"), F.lit(None).cast("double").alias("score"))
    open_ = queries.join(known.select("query_id"), "query_id", "left_anti").select("query_id", "topic", "vector")
    newest = retrieval.first_of(snapshots, ["topic", "project"], F.desc("place")).drop("place")
    missing = summaries.join(snapshots.select("project").distinct(), "project", "left_anti").select(newest.columns)

    def best(asked: DataFrame, rows: DataFrame, floor: float, stage: str) -> DataFrame:
        near = nearest(
            asked, rows, 1, _rounded, within="topic", ties=lambda q, r: r["project"], row_columns=["project"]
        ).where(F.col("score") >= floor)
        found = near.join(rows.select("id", "project"), "id")
        return written(found.select("query_id", F.lit(stage).alias("stage"), F.col("project").cast("long"), "score"), f"routes-{stage}")

    by_latest = best(open_, newest.unionByName(missing), latest_floor, "latest")
    rest = open_.join(by_latest.select("query_id"), "query_id", "left_anti")
    by_history = best(rest, snapshots.select(newest.columns).unionByName(missing), history_floor, "history")
    found = known.unionByName(by_latest).unionByName(by_history)
    topics = newest.select("topic").unionByName(missing.select("topic")).distinct().withColumn("has_projects", F.lit(True))
    told = queries.join(found, "query_id", "left").join(topics, "topic", "left")
    none = F.when(F.col("has_projects"), "no_project").otherwise("no_topic")
    return told.select("query_id", F.coalesce("stage", none).alias("stage"), "project", "score")


def recalled(
    queries: DataFrame, mapping: DataFrame, snapshots: DataFrame, summaries: DataFrame, turns: DataFrame, vectors: DataFrame, k: int,
    latest_floor: float = LATEST_FLOOR, history_floor: float = HISTORY_FLOOR,
) -> DataFrame:
    """(query_id, stage, project, verdict, best, id, rank, similarity): what memory knows of each query.

    The route decides which project's turns are searched, and these whether they suffice: FULL or PARTIAL with the turns
    that support it, NONE without any. Queries without a project, or in whose project nothing is found, end there, with
    one row and no verdict. A turn without a vector can't support an answer.
    """
    routes = written(routed(queries, mapping, snapshots, summaries, latest_floor, history_floor), "routes")
    asked = queries.join(routes.where("project is not null").select("query_id", "project"), "query_id").withColumn("only", F.lit(0))
    passages = written(local_context(asked, turns, vectors, k), "passages")
    both = passages.join(vectors, "id", "left").join(queries.select("query_id", F.col("vector").alias("wanted")), "query_id")
    both = both.select("query_id", "id", "rank", F.round(cosine(F.col("wanted"), F.col("vector")), 6).alias("similarity"))
    best = both.groupBy("query_id").agg(F.max("similarity").alias("best"))
    best = best.withColumn("verdict", verdict(F.col("best")))
    support = both.where(F.col("similarity") >= PARTIAL)
    told = routes.join(best, "query_id", "left").join(support, "query_id", "left")
    return told.select("query_id", "stage", "project", "verdict", "best", "id", "rank", "similarity")
