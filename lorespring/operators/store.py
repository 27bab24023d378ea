"""Stores of chunks, snapshots and jobs: lookups, rollups, deletions, and what is shown of them in order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespring.functions import text as T
from lorespring.operators import lexical, retrieval
from lorespring.operators.vectors import Attributes, cosine_scores, nearest, ranked


def hybrid(
    docs: DataFrame, vectors: DataFrame, texts: DataFrame, query_vectors: DataFrame, k: int, owners: DataFrame, viewer: str | None, below: bool = False
) -> DataFrame:
    """(query_id, id, score, rank, spent): dense and lexical search, each four times ``k`` deep, fused and assembled.

    What the viewer may not see goes after hydration, then repeated texts, then what exceeds the token budget. Where any
    document has an owner, both searches go twice as deep, so that others' documents leave places; with ``below`` only
    what the viewer may see is searched at all, and none is ever lost to them.
    """
    scores = lambda q, r: cosine_scores(q, r).round(6)
    pool, eligible = 4 * k, None
    if below:
        eligible = retrieval.visible(docs.select(F.col("id").alias("doc_id")), owners, viewer).select(F.col("doc_id").alias("id"))
        vectors = vectors.join(retrieval.hidden(owners, viewer), "id", "left_anti")
    elif not owners.isEmpty():
        pool *= 2
    dense = nearest(query_vectors, vectors, pool, scores).select("query_id", F.lit("dense").alias("list"), "id", "rank")
    words = lexical.bm25(docs, texts, pool, eligible=eligible).select("query_id", F.lit("lexical").alias("list"), "id", "rank")
    found = retrieval.hydrate(retrieval.fuse(dense.unionByName(words), pool=pool), docs).where(F.col("text").isNotNull())
    if not below:
        found = retrieval.visible(found.withColumnRenamed("id", "doc_id"), owners, viewer).withColumnRenamed("doc_id", "id")
    unique = ranked(retrieval.deduplicated(found).withColumnRenamed("rank", "place"), ["query_id"], F.asc("place"), limit=k)
    return retrieval.within_budget(unique, T.tokens_down(F.col("text"))).select("query_id", "id", "score", "rank", "spent")


def provenance(chunks: DataFrame, urls: DataFrame, key: str) -> DataFrame:
    """``chunks`` with the URL of their document, or its id where it has none."""
    return chunks.join(urls, key, "left").withColumn("url", F.coalesce("url", F.col(key).cast("string")))


def best_between(queries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(query_id, id, place, score): of a query's project the snapshot nearest to it between its cursors, both included.

    ``queries`` has query_id, project, low, high and vector, ``snapshots`` project, id, place and vector, the cursors
    being places. Both cursors move inwards, the left one looking first: of equal scores the one seen first wins.
    """

    def seen(q: Attributes, r: Attributes) -> np.ndarray:
        left, right = r["place"] - q["low"], q["high"] - r["place"]
        return 2 * np.minimum(left, right) + (left > right)

    inside = lambda q, r: (q["low"] <= r["place"]) & (r["place"] <= q["high"])
    scores = lambda q, r: cosine_scores(q, r).round(6)
    last = snapshots.groupBy("project").agg(F.max("place").alias("last"))
    asked = queries.join(last, "project").withColumn("high", F.least("high", "last")).withColumn("low", F.greatest("low", F.lit(0)))
    best = nearest(
        asked, snapshots, 1, scores, within="project", admits=inside, ties=seen, query_columns=["low", "high"], row_columns=["place"]
    )
    return best.join(snapshots.select("id", "place"), "id").select("query_id", "id", "place", "score")


def latest(snapshots: DataFrame, by: str, *newest: str) -> DataFrame:
    """The newest row of each group, by columns in order."""
    return ranked(snapshots, [by], *(F.desc(c) for c in newest), limit=1).drop("rank")


def rolled_forward(summaries: DataFrame, marks: DataFrame, key: str, order: str) -> DataFrame:
    """The summaries behind the last snapshot of their project; all where it has none yet."""
    return summaries.join(marks, key, "left").where(F.col(order) > F.coalesce("last", F.lit(-1))).drop("last")


def history_start(exchanges: Column, window: int) -> Column:
    """The first exchange to show, moving in steps of half a window."""
    step = max(1, window // 2)
    steps = F.floor((exchanges - window) / F.lit(step)) + 1
    return F.when((exchanges <= window) | F.lit(window < 1), F.lit(0)).otherwise(steps * step).cast("long")


def evidence_order(evidence: DataFrame, cited: DataFrame) -> DataFrame:
    """Evidence (query_id, ref, score) with its place: cited first, then by score, then by ref."""
    marked = evidence.join(cited.withColumn("cited", F.lit(True)), ["query_id", "ref"], "left")
    marked = marked.withColumn("cited", F.coalesce("cited", F.lit(False)))
    return ranked(marked, ["query_id"], F.desc("cited"), F.desc("score"), F.asc("ref"))


def distinct_strings(values: Column, most: int) -> Column:
    """The first spelling of each string, whatever the case, without empty ones, in order and up to ``most``."""
    trimmed = F.filter(F.transform(values, F.trim), lambda v: v != "")
    lower = F.transform(trimmed, F.lower)
    kept = F.filter(trimmed, lambda v, i: F.array_position(lower, F.lower(v)) == i + 1)
    return F.slice(kept, 1, most)


def soft_deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``table`` with is_active 'f' for the given keys; other rows stay as they are."""
    gone = keys.select(key).distinct().withColumn("gone", F.lit(True))
    return table.join(gone, key, "left").withColumn("is_active", F.when(F.col("gone"), "f").otherwise(F.col("is_active"))).drop("gone")


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows that stay when those with the given keys are deleted."""
    return table.join(keys.select(key), key, "left_anti")


def outcome(done: Column, failed: Column) -> Column:
    """COMPLETED, PARTIAL or FAILED, by how many files of an upload were taken and how many not."""
    return F.when(done == 0, "FAILED").when(failed > 0, "PARTIAL").otherwise("COMPLETED")


def merged(listed: DataFrame, page: DataFrame, key: str) -> DataFrame:
    """A list with the rows of another page that it lacks; whoever shows it sorts it."""
    return listed.unionByName(page.join(listed.select(key), key, "left_anti").select(listed.columns))


#: Fewer tokens at the start of a prompt are not worth keeping a state for.
LEAST_PREFIX = 32


def common_prefix(a: Column, b: Column) -> Column:
    """How many elements two arrays share at their start; nulls in both are equal."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    shorter = F.least(F.size(a), F.size(b))
    return F.when(differs == 0, shorter).otherwise(F.least(differs - 1, shorter)).cast("int")


def section_chars(tokens: Column) -> dict[str, Column]:
    """Characters that each section of a prompt of so many tokens may take."""
    chars = tokens * 4
    shares = {"request": 4, "results": 3, "evidence": 5, "history": 6, "summary": 24}
    return {name: F.floor(chars / F.lit(part)).cast("long") for name, part in shares.items()}


def imported(existing: DataFrame, records: DataFrame) -> DataFrame:
    """New rows (id, owner, given, name) of records (id, owner, name), renamed where an owner has the name already.

    Ids that exist are left out. First come the records whose name is free, then all others in order of id, with the
    smallest suffixes that are free; where the bare stem is free, the first takes it. The k-th free number is found
    in one pass: each taken number is put behind the free ones below it.
    """
    new = records.join(existing.select("id"), "id", "left_anti")
    suffix = F.regexp_extract("name", r" \((\d+)\)$", 1)

    def split(df: DataFrame) -> DataFrame:
        return df.withColumn("stem", T.name_stem(F.col("name"))).withColumn("k", F.when(suffix == "", 1).otherwise(suffix.try_cast("long")))

    held = split(existing).select("owner", "stem", "k").distinct()
    first = ranked(split(new), ["owner", "stem", "k"], F.asc("id")).join(held.withColumn("held", F.lit(True)), ["owner", "stem", "k"], "left")
    keeps = F.col("held").isNull() & (F.col("rank") == 1)
    kept = first.where(keeps).select("id", "owner", F.col("name").alias("given"), "name", "stem", "k")
    taken = held.unionByName(kept.select("owner", "stem", "k")).distinct()
    taken = ranked(taken, ["owner", "stem"], F.asc("k")).select("owner", "stem", (F.col("k") - F.col("rank")).alias("at"), F.lit(1).alias("is_taken"))
    moved = ranked(first.where(~keeps).drop("rank"), ["owner", "stem"], F.asc("id")).select("owner", "stem", (F.col("rank") - 1).alias("at"), F.lit(0).alias("is_taken"), "id", F.col("name").alias("given"))
    both = moved.unionByName(taken, allowMissingColumns=True)
    # Free numbers below a taken one: those of the moved rows that stand before it.
    same = Window.partitionBy("owner", "stem").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("number", F.col("at") + 1 + F.sum("is_taken").over(same)).where("is_taken = 0")
    name = F.concat("stem", F.when(F.col("number") == 1, "").otherwise(F.concat(F.lit(" ("), F.col("number").cast("string"), F.lit(")"))))
    return kept.drop("stem", "k").unionByName(both.select("id", "owner", "given", name.alias("name")))


def canonical(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """``rows`` with a name as it is already spelt in ``known`` (name), whatever the case; stripped where it is new."""
    spelt = known.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("spelt"))
    rows = rows.withColumn(column, T.strip_white(F.col(column))).withColumn("key", F.lower(column))
    return rows.join(spelt, "key", "left").withColumn(column, F.coalesce("spelt", column)).drop("key", "spelt")


def snapshot_history(snapshots: DataFrame, projects: DataFrame, *order: str) -> DataFrame:
    """The snapshots of the given projects, each with its place in its project's history."""
    return ranked(snapshots.join(projects, "project"), ["project"], *(F.asc(c) for c in order)).withColumnRenamed("rank", "place")


def rebuild_due(pending: Column, forced: Column, least: int = 10_000) -> Column:
    """Whether so many vectors wait that an index is built anew."""
    return (pending >= least) | forced


def vector_id_problem(vector_id: Column) -> Column:
    """Why an id can't be stored; null for one that can."""
    return F.when(vector_id.isNull(), "missing").when(vector_id < 0, "malformed")


def skip_reason(reason: Column) -> dict[str, Column]:
    """Status and code of a file that was left out, by what the ingestion says of it."""
    quota, store = F.contains(reason, F.lit("storage limit")), F.contains(reason, F.lit("vector store"))
    code = F.when(quota, "QUOTA_EXCEEDED").when(store, "VECTOR_STORE_UNAVAILABLE").when(reason == "no text", "NO_TEXT").otherwise("MALFORMED")
    return {"status": F.when(quota | store, "NOT_INGESTED").otherwise("FAILED"), "code": code}


def ready(jobs: DataFrame, blocked: DataFrame, key: str, by: list[str], *order: Column) -> DataFrame:
    """Jobs that wait for nothing, in the order in which they are taken."""
    return ranked(jobs.join(blocked.select(key), key, "left_anti"), by, *order)


def navigated(history: DataFrame, moves: DataFrame) -> DataFrame:
    """(project, low, high) after moves over each project's history (project, place), places from 1 on.

    ``moves`` (project, advance, back) counts the steps of the left cursor on and of the right one back. Neither passes
    the other; the left one, which moves first, stops at the right one.
    """
    spans = history.groupBy("project").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    both = spans.join(moves, "project", "left")
    low = F.least(F.col("first") + F.coalesce("advance", F.lit(0)), F.col("last"))
    high = F.greatest(F.col("last") - F.coalesce("back", F.lit(0)), F.col("low"))
    return both.withColumn("low", low).select("project", "low", high.alias("high"))


def compensated(uploads: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Uploads (key, was_there) with status, and whether their owner row and file go: all that was new and not ingested."""
    both = uploads.join(outcomes, "key", "left").withColumn("status", F.coalesce("status", F.lit("FAILED")))
    failed = F.col("status") != "INGESTED"
    return both.withColumn("owner_removed", failed).withColumn("file_removed", failed & ~F.col("was_there"))
