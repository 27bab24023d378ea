"""Evidence for one question from several sub-queries: united, verified and tagged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespring.operators import retrieval
from lorespring.operators.vectors import PARTIAL, cosine, ranked, verdict

#: Passages from outside memory that count as evidence, at most.
MOST = 10


def verified_union(hits: DataFrame, vectors: DataFrame, questions: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The evidence (query_id, ref, id, part, score, similarity, rank), and (query_id, verdict, best, n_passages).

    ``hits`` has (query_id, part, id, score, rank), ``part`` being 0 for the question itself and then its sub-queries in
    order. A passage counts once, by its best score, of equal ones by that of the first part. Whether all suffice is
    judged by the question's own vector (query_id, vector) against the passages' (id, vector), and the evidence is what
    supports it, nearest first, of equal ones the one that was found first, ``most`` at the most, tagged G1, G2 and so
    on. A passage without a vector supports nothing; a question without hits is ``empty``.
    """
    first = hits.groupBy("query_id", "id").agg(F.min(F.struct("part", "rank")).alias("found"))
    best = retrieval.best_per_id(hits).join(first, ["query_id", "id"])
    both = best.join(vectors, "id", "left").join(questions.select("query_id", F.col("vector").alias("wanted")), "query_id")
    both = both.select("query_id", "id", "part", "score", "found", F.round(cosine(F.col("wanted"), F.col("vector")), 6).alias("similarity"))
    judged = both.groupBy("query_id").agg(F.max("similarity").alias("best"), F.count("*").alias("n_passages"))
    told = questions.select("query_id").join(judged, "query_id", "left")
    told = told.select(
        "query_id",
        F.when(F.col("n_passages").isNull(), "empty").otherwise(verdict(F.col("best"))).alias("verdict"),
        "best",
        F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"),
    )
    kept = ranked(both.where(F.col("similarity") >= PARTIAL), ["query_id"], F.desc("similarity"), F.asc("found"), limit=most)
    return retrieval.tagged(kept, "G").select("query_id", "ref", "id", "part", "score", "similarity", "rank"), told
