"""From ranked lists to an answer's context: fusion, access, deduplication, diversity, budgets, reading order.

Every operator takes any number of queries at once, by ``query_id``, and keeps order as an explicit rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespring.functions import text as T
from lorespring.operators.vectors import cosine_scores, ranked

RRF_K, BUDGET, MMR_LAMBDA = 60, 2048, 0.7


def fuse(lists: DataFrame, k: int = RRF_K, pool: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list, id, rank): query_id, id, score, sources, rank.

    Ties go to what comes first in the earliest list. An id that a list holds twice counts twice.
    """
    fused = lists.groupBy("query_id", "id").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"),
        F.array_sort(F.collect_set("list")).alias("sources"),
        F.min(F.struct("list", "rank")).alias("seen"),
    )
    fused = fused.withColumn("score", F.round("score", 12))
    return ranked(fused, ["query_id"], F.desc("score"), F.col("seen").asc(), limit=pool).drop("seen")


def visible(docs: DataFrame, owners: DataFrame, viewer: str | None) -> DataFrame:
    """The rows of ``docs`` (doc_id, ...) that a viewer may see: those without an owner row, and the viewer's own."""
    public = docs.join(owners.select("doc_id"), "doc_id", "left_anti")
    if viewer is None:
        return public
    return public.unionByName(docs.join(owners.where(F.col("owner") == viewer).select("doc_id"), "doc_id", "left_semi"))


def hidden(owners: DataFrame, viewer: str | None) -> DataFrame:
    """The ids of what has owners, the viewer not among them."""
    own = owners.where(F.lit(False) if viewer is None else F.col("owner") == viewer).select("doc_id")
    return owners.select("doc_id").distinct().join(own, "doc_id", "left_anti").select(F.col("doc_id").alias("id"))


def hydrate(hits: DataFrame, *stores: DataFrame) -> DataFrame:
    """Hits (query_id, id, ...) with the text that any of the stores (id, text) has; null where none has it."""
    texts = stores[0]
    for store in stores[1:]:
        texts = texts.unionByName(store)
    return hits.join(texts, "id", "left")


def first_of(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    return ranked(df, by, *order).where("rank = 1").drop("rank")


def deduplicated(passages: DataFrame) -> DataFrame:
    """Of (query_id, rank, id, text) in order, what has neither an id nor a text (white space folded) kept before.

    A row that falls by its text doesn't make its id known, so the rows of a query are gone through in order; they are
    the pool of one ranking, which is bounded.
    """
    keyed = passages.withColumn("key", T.fold_white(F.col("text")))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, seen, kept = rows.sort_values("rank"), set(), []
        for i, key in zip(rows["id"], rows["key"], strict=True):
            new = ("id", i) not in seen and ("text", key) not in seen
            kept.append(new)
            seen |= {("id", i), ("text", key)} if new else set()
        return rows.loc[kept].drop(columns="key")

    return keyed.groupBy("query_id").applyInPandas(fold, passages.schema)


def within_budget(
    passages: DataFrame, cost: Column, budget: int = BUDGET, by: tuple[str, ...] = ("query_id",), order: str = "rank",
    keep_first: bool = False,
) -> DataFrame:
    """Passages in order until the first that would exceed the budget; the first one in any case if asked for."""
    window = Window.partitionBy(*by).orderBy(order)
    spent = F.sum(cost).over(window.rowsBetween(Window.unboundedPreceding, 0))
    out = passages.withColumn("spent", spent)
    fits = F.col("spent") <= budget
    if keep_first:
        out = out.withColumn("nth", F.row_number().over(window))
        return out.where(fits | (F.col("nth") == 1)).drop("nth")
    return out.where(fits)


def reading_order(passages: DataFrame) -> DataFrame:
    """A rank by document and place in it."""
    order = (F.coalesce("document_id", F.lit("")), F.coalesce("start", F.lit(0)), F.col("rank"))
    window = Window.partitionBy("query_id").orderBy(*order)
    return passages.withColumn("reading_rank", F.row_number().over(window))


def diversified(passages: DataFrame, k: int, weight: float = MMR_LAMBDA) -> DataFrame:
    """Maximal marginal relevance over (query_id, rank, id, score, vector): query_id, id, rank.

    Relevance is the score scaled over a query's pool. The first pick is the most relevant; each next one has the most
    relevance less repetition, ties to the earlier rank. A pool of k or fewer stays as it is. A pool is a query's
    candidates, whose number the search before has set.
    """

    def pick(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("rank", ignore_index=True)
        chosen = list(range(len(pool)))
        if len(pool) > k:
            score = pool["score"].to_numpy(dtype=float)
            spread = score.max() - score.min()
            relevance = np.ones(len(pool)) if spread == 0 else (score - score.min()) / spread
            vectors = np.array(pool["vector"].tolist(), dtype=float)
            alike = cosine_scores(vectors, vectors)
            chosen = [int(relevance.argmax())]
            repeated = alike[:, chosen[0]].copy()
            while len(chosen) < k:
                value = weight * relevance - (1 - weight) * repeated
                value[chosen] = -np.inf
                chosen.append(int(value.argmax()))
                repeated = np.maximum(repeated, alike[:, chosen[-1]])
        out = pool.iloc[chosen][["query_id", "id"]].reset_index(drop=True)
        out["rank"] = np.arange(1, len(out) + 1, dtype="int32")
        return out

    return passages.groupBy("query_id").applyInPandas(pick, "query_id long, id long, rank int")


def best_per_id(hits: DataFrame) -> DataFrame:
    """Over several sub-queries' hits (query_id, part, id, score), the best score of each id and the part it is from."""
    best = hits.groupBy("query_id", "id").agg(F.max(F.struct("score", (-F.col("part")).alias("part"))).alias("best"))
    return best.select("query_id", "id", "best.score", (-F.col("best.part")).alias("part"))


def tagged(evidence: DataFrame, prefix: str) -> DataFrame:
    """Evidence with references such as M1, M2 by rank."""
    return evidence.withColumn("ref", F.concat(F.lit(prefix), F.col("rank")))


def reranked(passages: DataFrame, scores: DataFrame) -> DataFrame:
    """Passages (query_id, id, score, rank) in the order of a scorer's ``scores`` (query_id, id, new_score).

    A single passage stays, and so does the order of a query where any of its passages has no score or no number.
    """
    both = passages.join(scores, ["query_id", "id"], "left")
    whole = Window.partitionBy("query_id")
    bad = F.col("new_score").isNull() | F.isnan("new_score")
    usable = (F.count("*").over(whole) > 1) & ~F.bool_or(bad).over(whole)
    both = both.withColumn("usable", usable).withColumn("score", F.when(F.col("usable"), F.col("new_score")).otherwise(F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("usable"), -F.col("new_score")), "rank", "id")
    return both.withColumn("place", F.row_number().over(order)).select("query_id", "id", "score", F.col("place").alias("rank"))


def visible_below(rows: DataFrame, parents: DataFrame, owners: DataFrame, viewer: str | None) -> DataFrame:
    """The rows (child, ...) that a viewer may see by the document (child, doc_id) that they lie in; all else is public."""
    return visible(rows.join(parents, "child", "left"), owners, viewer)
