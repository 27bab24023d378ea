"""Batch forms of inserts, upserts, updates and deletes on tables without a table format, and integrity audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespring.functions import text as T
from lorespring.operators.steps import Rounds, discard, written


def new_rows(existing: DataFrame, batch: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The rows of a batch to append: the first of each key, where the table hasn't the key yet; nulls are equal."""
    first = batch.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    first, known = first.where("nth = 1").drop("nth").alias("n"), existing.select(*keys).alias("o")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return first.join(known, reduce(lambda a, b: a & b, same), "left_anti")


def upserted(existing: DataFrame, batch: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """The table with a batch written over it; ``kept`` columns stay as the table has them."""
    old, new = existing.alias("o"), batch.alias("n")
    both = old.join(new, keys, "full")
    out = list(keys)
    for c in existing.columns:
        if c not in keys:
            o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
            out.append((F.coalesce(o, n) if c in kept else F.coalesce(n, o)).alias(c))
    return both.select(*out)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with a number from 1 on by columns in order.

    Numbers are given within ranges of the order and then shifted by the ranges before, so no task sees all rows.
    """
    # Written once: the number of a range must be the same for its rows and its size.
    ranged = written(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    placed = ranged.withColumn("place_in_part", place).join(F.broadcast(sizes), "part")
    return placed.withColumn(name, (F.col("before") + F.col("place_in_part")).cast("long")).drop("part", "before", "place_in_part")


def merged_labels(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """(pos, vector_id, chunk_id, model, label, verdict): what becomes of each request for a label.

    ``requests`` has (pos, vector_id, chunk_id, model) with distinct positions, ``labels`` (label, vector_id, chunk_id,
    model), where no vector and no chunk occurs twice. In order of position, a request whose chunk and vector are both
    new is ``created`` and gets the next free label, one that has its label gets that: ``same``, or ``other_model`` if
    another model made it; where only one of the two is known, or both from different rows, it is a ``conflict``. A
    request without a vector or chunk is ``malformed``. Only created ones are new to the requests behind them: a round
    decides the requests that are first of both their chunk and their vector among the undecided, and those that meet
    what it creates.
    """
    columns = ["pos", "vector_id", "chunk_id", "model"]
    bad = F.col("vector_id").isNull() | (F.col("vector_id") < 0) | F.col("chunk_id").isNull()
    open_ = written(requests.where(~bad).select(columns), "requests")
    decided = Rounds(requests.sparkSession, "decided")

    def settled(asked: DataFrame, held: DataFrame) -> DataFrame:
        """Verdicts of the requests that meet a held row, with its position or label as ``owner``."""
        mine = held.select("owner", F.col("vector_id").alias("v"), F.col("chunk_id").alias("c"), F.col("model").alias("m"))
        both = asked.join(mine.select("c", F.struct("owner", "v", "m").alias("by_chunk")), asked["chunk_id"] == F.col("c"), "left")
        both = both.join(mine.select("v", F.col("owner").alias("by_vector")), both["vector_id"] == F.col("v"), "left")
        met = both.where(F.col("by_chunk").isNotNull() | F.col("by_vector").isNotNull())
        same = F.coalesce(F.col("by_chunk.v") == F.col("vector_id"), F.lit(False))
        verdict = F.when(~same, "conflict").when(F.col("by_chunk.m").eqNullSafe(F.col("model")), "same").otherwise("other_model")
        return met.select(*columns, F.when(same, F.col("by_chunk.owner")).alias("owner"), verdict.alias("verdict"))

    # Labels and positions are told apart: an owner below 0 is a label.
    stored = labels.select((-1 - F.col("label")).alias("owner"), "vector_id", "chunk_id", "model")
    front = decided.add(settled(open_, stored))
    while True:
        rest = written(open_.join(front.select("pos"), "pos", "left_anti"), "requests")
        discard(open_)
        open_ = rest
        if open_.isEmpty():
            break
        firsts = open_.withColumn("a", F.min("pos").over(Window.partitionBy("chunk_id"))).withColumn("b", F.min("pos").over(Window.partitionBy("vector_id")))
        new = firsts.where((F.col("pos") == F.col("a")) & (F.col("pos") == F.col("b"))).drop("a", "b")
        new = written(new.withColumn("owner", F.col("pos")), "created")
        others = open_.join(new.select("pos"), "pos", "left_anti")
        front = decided.add(new.withColumn("verdict", F.lit("created")).unionByName(settled(others, new)))
        discard(new)
    top = labels.agg(F.coalesce(F.max("label"), F.lit(0)).alias("top"))
    made = numbered(decided.rows().where("verdict = 'created'").select("pos"), "nth", "pos").join(F.broadcast(top))
    made = made.select(F.col("pos").alias("owner"), (F.col("top") + F.col("nth")).alias("made"))
    out = decided.rows().join(made, "owner", "left")
    label = F.when(F.col("made").isNotNull(), F.col("made")).when(F.col("owner") < 0, -1 - F.col("owner"))
    out = out.select(*columns, label.cast("long").alias("label"), "verdict")
    malformed = requests.where(bad).select(*columns, F.lit(None).cast("long").alias("label"), F.lit("malformed").alias("verdict"))
    return out.unionByName(malformed)


def labelled(existing: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Each key of a batch with its label: the table's, or the next free ones in order.

    Numbers are given within ranges of the order and then shifted by the ranges before, so no task sees all new keys.
    """
    known = batch.join(existing.select(key, "label"), key, "left")
    fresh = known.where("label is null").drop("label")
    top = existing.agg(F.coalesce(F.max("label"), F.lit(0)).alias("top"))
    given = numbered(fresh, "nth", order).join(F.broadcast(top))
    given = given.withColumn("label", F.col("top") + F.col("nth")).drop("top", "nth")
    return known.where("label is not null").unionByName(given)


def looked_up(table: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a table at any of the keys, whose columns have the same names; nulls are equal."""
    t, k = table.alias("t"), keys.select(*columns).alias("k")
    return t.join(k, reduce(lambda a, b: a & b, (F.col(f"t.{c}").eqNullSafe(F.col(f"k.{c}")) for c in columns)), "left_semi")


def identifier_verdict(value: Column) -> Column:
    """A struct of an identifier without surrounding white space, null where there is nothing else, and whether it can be one."""
    stripped = T.strip_white(value)
    good = F.coalesce(stripped != "", F.lit(False))
    return F.struct(F.when(good, stripped).alias("identifier"), good.alias("usable"))


def updated(table: DataFrame, changes: DataFrame, keys: list[str], where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The table with changes (keys and new values), and (keys, n_rows, verdict) of each change.

    A change replaces the columns that it has in all rows of its key, those that ``where`` holds for if it is given. Of
    changes that share a key one counts, by the order of their values. The verdict is ``updated`` or ``not found``.
    """
    values = [c for c in changes.columns if c not in keys]
    one = changes.groupBy(*keys).agg(F.min(F.struct(*values)).alias("new"))
    marked = table.withColumn("holds", F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
    both = marked.join(one, keys, "left").withColumn("hit", F.col("holds") & F.col("new").isNotNull())
    rows = both.select(*(F.when(F.col("hit"), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))
    counts = both.where("hit").groupBy(*keys).agg(F.count("*").alias("n_rows"))
    told = one.select(*keys).join(counts, keys, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))
    return rows, told.withColumn("verdict", F.when(F.col("n_rows") > 0, "updated").otherwise("not found"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent is missing, null keys included."""
    return child.join(parent.select(key), key, "left_anti")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def failing(df: DataFrame, name: str, rule: Column, key: str) -> DataFrame:
    """(check, key) of the rows that a rule doesn't hold for; unknown passes, as in a CHECK constraint."""
    return df.where(~F.coalesce(rule, F.lit(True))).select(F.lit(name).alias("check"), F.col(key).cast("string").alias("key"))
