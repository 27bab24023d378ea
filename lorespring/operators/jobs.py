"""Plans of jobs: what is wrong with them, in which order they run, and what a job is told of those it depends on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespring.functions import text as T
from lorespring.operators.steps import Rounds, discard, written
from lorespring.operators.tables import numbered

#: The least number of characters of each result that a job is told.
LEAST_SHARE = 200


def trimmed(nodes: DataFrame, edges: DataFrame) -> Rounds:
    """(id, level) of the ids that can be taken one after the other, each once all that it needs is.

    ``edges`` are distinct (id, needs). A round writes its own ids, and for the ids that need any of them how many of
    their needs it met; only these ids' counts are summed to find the next round, so nothing is rewritten. The level is
    the length of the longest chain below an id, and so is the number of rounds.
    """
    spark, edges = nodes.sparkSession, written(edges, "edges")
    degree = written(edges.groupBy("id").agg(F.count("*").alias("degree")), "degrees")
    placed, met = Rounds(spark, "placed"), Rounds(spark, "met")
    front = placed.add(nodes.join(degree, "id", "left_anti").select("id", F.lit(0).alias("level")))
    level = 0
    while not front.isEmpty():
        level += 1
        told = front.select(F.col("id").alias("needs"))
        touched = met.add(edges.join(told, "needs", "left_semi").groupBy("id").agg(F.count("*").alias("n")))
        sums = met.rows().join(touched.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("n").alias("n"))
        ready = sums.join(degree, "id").where(F.col("n") == F.col("degree"))
        front = placed.add(ready.select("id", F.lit(level).alias("level")))
    met.discard()
    discard(edges)
    discard(degree)
    return placed


def _among(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges between nodes."""
    return edges.join(nodes, "id", "left_semi").join(nodes.select(F.col("id").alias("needs")), "needs", "left_semi").select("id", "needs")


def checked_plan(jobs: DataFrame, needs: DataFrame) -> DataFrame:
    """(id, place, verdict, level, position) of each row of a plan.

    ``jobs`` has (id, place), ids being strings and places distinct, ``needs`` (id, needs). A row is ``empty`` without a
    name, a ``duplicate`` behind the first of its name, ``self`` if it needs itself, ``unknown`` if it needs what isn't
    there, ``cycle`` if it lies in a cycle or between cycles, and ``blocked`` if what it waits for never runs; else it
    is ``ok`` and has a level, the length of the longest chain below it, and its position by level, then by place.
    """
    by_name = Window.partitionBy("id").orderBy("place")
    rows = jobs.withColumn("nth", F.row_number().over(by_name))
    rows = rows.withColumn("empty", F.coalesce(F.trim("id") == "", F.lit(True)))
    rows = written(rows, "plan")
    ids = rows.where("not empty and nth = 1").select("id")
    edges = written(needs.join(ids, "id", "left_semi").select("id", "needs").distinct(), "needs")
    own = edges.where("id = needs").select("id").withColumn("self", F.lit(True))
    unknown = edges.join(ids.select(F.col("id").alias("needs")), "needs", "left_anti").select("id").distinct().withColumn("unknown", F.lit(True))
    forward = trimmed(ids, edges)
    rest = written(ids.join(forward.rows().select("id"), "id", "left_anti"), "waiting")
    # Without needs of their own and unknown ones, only cycles and what waits for them are left; from the other end, only cycles.
    inner = _among(rest, edges.where("id <> needs"))
    left = written(rest.join(trimmed(rest, inner).rows().select("id"), "id", "left_anti"), "held")
    reversed_ = _among(left, inner).select(F.col("needs").alias("id"), F.col("id").alias("needs"))
    core = left.join(trimmed(left, reversed_).rows().select("id"), "id", "left_anti").withColumn("cycle", F.lit(True))

    told = rows.join(own, "id", "left").join(unknown, "id", "left").join(core, "id", "left").join(forward.rows(), "id", "left")
    verdict = (
        F.when(F.col("empty"), "empty")
        .when(F.col("nth") > 1, "duplicate")
        .when(F.col("self"), "self")
        .when(F.col("unknown"), "unknown")
        .when(F.col("cycle"), "cycle")
        .when(F.col("level").isNull(), "blocked")
        .otherwise("ok")
    )
    told = written(told.select("id", "place", verdict.alias("verdict"), "level"), "verdicts")
    good = numbered(told.where("verdict = 'ok'"), "position", "level", "place")
    bad = told.where("verdict <> 'ok'").withColumn("level", F.lit(None).cast("int")).withColumn("position", F.lit(None).cast("long"))
    return good.unionByName(bad)


def accepted(log: DataFrame) -> DataFrame:
    """(id, output) of the jobs whose last entry in a log (id, at, kind, output) accepts a result rather than retracts it."""
    last = log.groupBy("id").agg(F.max_by(F.struct("kind", "output"), "at").alias("last"))
    return last.where("last.kind = 'accept'").select("id", F.col("last.output").alias("output"))


def dependency_context(needs: DataFrame, results: DataFrame, budget: int) -> DataFrame:
    """(id, needs, text): what each job (id) is told of the accepted results (id, output) that it needs.

    The results that are there share the budget of characters equally, but none gets less than ``LEAST_SHARE``.
    """
    told = needs.join(results.select(F.col("id").alias("needs"), "output"), "needs")
    share = F.greatest(F.lit(LEAST_SHARE), F.expr(f"{budget} div count(*) over (partition by id)")).cast("int")
    told = told.withColumn("share", share)
    return told.select("id", "needs", T.truncated(F.col("output"), F.col("share")).alias("text"))


def cited_evidence(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """The evidence (ref, ...) that any accepted result cites, with its place by letter, then by number."""
    refs = results.select(F.explode(F.regexp_extract_all("output", F.lit(r"\b([A-Z][0-9]{1,3})\b"))).alias("ref")).distinct()
    kept = evidence.join(refs, "ref", "left_semi")
    kept = kept.withColumns({"letter": F.left("ref", F.lit(1)), "number": F.expr("cast(substring(ref, 2) as int)")})
    return numbered(kept, "place", "letter", "number").drop("letter", "number")
