"""Mixing sources to target weights along a curriculum.

Targets share the corpus by source weight, no source giving more than ``max_epochs`` times its size (the excess goes
to the others by weight). Each source has a weight schedule over the training run, linear from a start to an end
weight; its integral is the source's cumulative demand, and inverting that demand at a document's place in its source
gives the document's training position. Sorting by range of position gives the training order.

Everything is DataFrame functions. Cumulative sizes come in two levels, so that a source with any share of the rows is
spread over many tasks: sums of (source, bucket), then running sums inside one bucket. Texts never enter a shuffle.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own, last in
order; ties and repeated rows are ordered by a hash of the id; a source of size 0 has target 0; an empty table gives
an empty result. Only doc_id, text and source are read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespring.llm.common import free_name, let, words

#: Weights by the source's place in code-point order, repeating, and how its schedule runs: start and end weight.
WEIGHTS = (5.0, 2.0, 1.0)
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
MAX_EPOCHS = 3


def _cycled(values: Sequence[float], place: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (place % len(values) + 1).cast("int"))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add place, weight and target to a table (source, source_size) with one row per source.

    Water filling: with sources in ascending order of cap / weight, the first that stays below its cap at the level
    of all remaining sources fixes the level; a source gets the smaller of its cap and level * weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sources.withColumn("place", F.row_number().over(order) - 1)
    placed = placed.withColumn("weight", _cycled(weights, F.col("place")))
    placed = placed.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    above = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    levels = placed.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
        / F.sum("weight").over(above),
    )
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(whole)
    return levels.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).drop("cap", "level")


def _position(done: Column, start: Column, end: Column) -> Column:
    """Where in the run (0 to 1) a linear schedule from ``start`` to ``end`` has met the share ``done`` of its demand."""
    bend = end - start
    root = F.sqrt(start * start + bend * (start + end) * done)
    return F.when(F.abs(bend) < 1e-12, done).otherwise((root - start) / bend)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
) -> DataFrame:
    """For each row of ``docs``: doc_id, source, size, source_size, target, taken, position and copies.

    ``taken`` counts the words that the mix takes from the document over all epochs; those of a source add up to its
    target, to the word. ``position`` is where the run first takes the document, null where it doesn't; ``copies``
    holds the positions of the epochs that take at least half of it.
    """
    sized = docs.select("doc_id", "source", F.size(words(docs["text"])).cast("long").alias("size"))
    n_buckets = math.isqrt(docs.count()) + 1  # as many buckets as rows in a bucket
    lot = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    share = F.conv(F.substring("lot", 1, 13), 16, 10).cast("double") / float(16**13)
    sized = sized.withColumn("lot", lot).withColumn("bucket", F.floor(share * n_buckets).cast("int"))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    per_source = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    plan = offsets.alias("o").join(
        targets(per_source, weights, max_epochs).alias("p"), F.col("o.source").eqNullSafe(F.col("p.source"))
    )
    plan = plan.select("o.source", "bucket", "offset", "source_size", "place", "target")

    inside = Window.partitionBy("source", "bucket").orderBy("lot", "doc_id", "size")
    running = sized.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    joined = running.alias("d").join(
        plan.alias("p"),
        F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket")),
    )
    start = F.coalesce(F.col("inside"), F.lit(0)) + F.col("offset")
    first, last = (_cycled([x[i] for x in schedules], F.col("place")) for i in (0, 1))
    parts, places = [], []
    for epoch in range(max_epochs):
        begin = start + epoch * F.col("source_size")
        parts.append(F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - begin)))
        done = F.least(F.lit(1.0), (begin + F.col("size") / 2.0) / F.greatest(F.col("target"), F.lit(1.0)))
        places.append(_position(done, first, last))
    copies = F.array(*(F.when((p > 0) & (2 * p >= F.col("size")), at) for p, at in zip(parts, places, strict=True)))
    return joined.select(
        "doc_id",
        F.col("d.source").alias("source"),
        "size",
        "source_size",
        "target",
        sum(parts, F.lit(0).cast("long")).alias("taken"),
        F.when(parts[0] > 0, places[0]).alias("position"),
        F.array_compact(copies).alias("copies"),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """The mix in order of position, as sorted ranges; rows that aren't taken come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes half of it or more, in training order.

    Texts are never cut. Rows without a word are left out, as nothing of them can be taken. Rows that share a doc_id
    (null is an id like any other) are mixed one by one, and each gets the copies of the first of them.
    """
    key, copies, position = (free_name(n, docs) for n in ("mix_key", "mix_copies", "mix_position"))
    mixed = mix(docs, **options).where(F.size("copies") > 0)
    plan = mixed.groupBy(F.struct("doc_id").alias(key)).agg(F.min("copies").alias(copies))
    out = docs.withColumn(key, F.struct("doc_id")).join(plan, key)
    out = out.withColumn(position, F.explode(copies))
    return out.orderBy(position, "doc_id").drop(key, copies, position)
