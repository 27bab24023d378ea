"""Connected components of a link table, by alternating large and small stars.

Each round hangs the larger neighbours of a node, then its smaller ones, on the smallest node it sees; the rounds end
when every component is a star around its smallest node, after a number of them that is logarithmic in the size of a
component. Links stay rows of a table throughout; each round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespring.llm.common import discard, written


def _large_star(links: DataFrame) -> DataFrame:
    """``links`` holds (u, v) with v < u."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.where(F.col("v") > F.col("u")).join(least, "u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in the link table (a, b) that is not its component's smallest.

    Links of a node with itself and null ends are ignored; a node that is in no link is in no row of the result.
    """
    a, b = F.col("a"), F.col("b")
    now = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(now, "links")
    state = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if new == state or not new.n:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = new
        after = written(_small_star(_large_star(now)), "links")
        discard(now)
        now = after


def forest(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a link matrix the smallest id that it reaches through the matrix."""
    big = np.iinfo(np.int64).max
    rows, columns = left.copy(), right.copy()
    while True:
        down = np.minimum(columns, np.where(mask, rows[:, None], big).min(axis=0))
        over = np.minimum(rows, np.where(mask, down[None, :], big).min(axis=1))
        if (down == columns).all() and (over == rows).all():
            return rows, columns
        rows, columns = over, down
