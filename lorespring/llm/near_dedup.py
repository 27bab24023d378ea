"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one vector kept a group.

All vectors of a label and width begin as one cell. A cell with more than ``SPLIT`` members is split: centroids are
fitted on a bounded sample of it, as many as it has thousands of members, and each vector goes to the nearest. That is
repeated where cells are still large, so cells grow in number with the data and not in size. A pair at or above the
threshold lies at most ``sqrt(2 - 2 * threshold)`` apart on the sphere, so a vector also visits each later cell whose
dividing plane is that near: no pair across cells is lost, however good or bad the cells are, and none meets twice, as
two visitors are not compared. Cells are compared block against block, each product in one task of bounded size; a
block returns how many links each vector has and a spanning forest of its links, never the pairs themselves. Where
vectors have no clusters most cells are visited, and the work is that of all block pairs: exactness costs this.

Equal vectors are compared once, with their number as weight, so a vector that a third of the rows share is one row.
An id with several different vectors has the links of all of them, each other id counted once; for such ids alone the
blocks return pairs.

Defined results: vectors compare only within one non-null label and one width; null vectors, zero vectors and those
with null or non-finite components link with nothing; rows that repeat a vec_id count as one id with all their
vectors, and get the same result each; a null vec_id gets a null component and is kept; an empty table gives an empty result. Only vec_id, label and embedding are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespring.llm.common import discard, grouped, mapped, written
from lorespring.llm.components import components, forest

#: Vectors of a cell that its centroids are fitted on, about, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 8
#: Members from which a cell is split, members of its parts on average, the most parts, and how often parts are split.
SPLIT, CELL, MOST_PARTS, LEVELS = 2048, 1024, 1024, 4
#: Vectors on one side of a block product, and of one task that assigns them to cells.
BLOCK, CHUNK = 2048, 16_384
#: Tables up to this many rows are broadcast; larger ones join by shuffle.
BROADCAST_ROWS = 100_000

PLACE = ["label", "width", "cell"]
_ROW = "id long, weight long, several boolean, label int, width int, cell string, visits boolean, guest int, vector binary"
_LINK = "id long, links long, root long, other long"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; first by the largest component, so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_cells(sample: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of spherical k-means, begun at evenly spaced rows of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def points(rows: pd.DataFrame, kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(rows["vector"]), dtype=kind).reshape(len(rows), -1).astype(np.float64))


def _packed(distinct: DataFrame) -> DataFrame:
    """The distinct vectors as rows of one cell a label and width."""
    names = [f.split()[0] for f in _ROW.split(", ")]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.binary()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column("embedding"), batch.num_rows
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy())
            width = np.diff(ends, prepend=0)
            vectors = [values[b - w : b].tobytes() for b, w in zip(ends.tolist(), width.tolist(), strict=True)]
            columns = [batch.column("id"), batch.column("weight"), batch.column("several"), batch.column("label"), width]
            columns += [[""] * n, [False] * n, [0] * n, vectors]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return mapped(distinct, pack, _ROW)


def _split(rows: DataFrame, large: DataFrame, level: int, reach: float, kind: str) -> DataFrame:
    """``rows`` with the large cells split: each vector in the cell of its nearest centroid, and in those it visits."""

    def fit(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("id")
        centres = fit_cells(points(sample, kind), min(len(sample), int(sample["parts"].iloc[0])))
        return pd.DataFrame({"label": [key[0]], "width": [key[1]], "cell": [key[2]], "centres": [centres.tobytes()]})

    def assign(_key: tuple, own: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        own = own[[f.split()[0] for f in _ROW.split(", ")]]
        if not len(own) or not len(fitted):
            return own
        x = points(own, kind)
        centres = np.frombuffer(fitted["centres"].iloc[0], dtype=np.float64).reshape(-1, x.shape[1])
        apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-18))
        near = x @ centres.T
        home = near.argmax(axis=1)
        gap = (near[np.arange(len(x)), home][:, None] - near) / apart[home]
        row, cell = np.nonzero((gap <= reach) & (np.arange(len(centres))[None, :] > home[:, None]))
        out = [own.assign(cell=own["cell"] + "." + pd.Series(home, own.index).astype(str), visits=False)]
        also = own.iloc[row].reset_index(drop=True)
        also["cell"] += "." + pd.Series(cell).astype(str)
        out.append(also.assign(visits=True, guest=also["guest"] | 1 << level))
        return pd.concat(out, ignore_index=True)

    listed = _small(large, large.count())
    keyed = rows.join(listed, PLACE)
    sample = keyed.where(~F.col("visits") & (F.pmod(F.xxhash64("id", F.lit(level)), F.col("members")) < SAMPLE))
    centres = grouped(sample.groupBy(*PLACE), fit, "label int, width int, cell string, centres binary")
    centres = written(centres, "centroids")
    keyed = keyed.select(*rows.columns, F.pmod(F.xxhash64("id", "vector"), F.col("chunks")).alias("chunk"))
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    fitted = centres.join(large, PLACE).select(*PLACE, "centres", chunks.alias("chunk"))
    chunk = [*PLACE, "chunk"]
    split = keyed.groupBy(*chunk).cogroup(fitted.groupBy(*chunk)).applyInPandas(assign, _ROW)
    out = written(split.unionByName(rows.join(listed, PLACE, "left_anti")), "cells")
    discard(centres)
    return out


def _cells(distinct: DataFrame, threshold: float, kind: str) -> DataFrame:
    """The vectors in cells, small ones as far as splitting makes them so."""
    reach = math.sqrt(2 - 2 * threshold) + 1e-6
    rows = written(_packed(distinct), "cells")
    for level in range(LEVELS):
        sizes = rows.groupBy(*PLACE).agg(F.count_if(~F.col("visits")).alias("members"), F.count("*").alias("n"))
        large = sizes.where(F.col("members") > SPLIT).select(
            *PLACE,
            "members",
            F.least(F.lit(MOST_PARTS), F.ceil(F.col("members") / CELL)).cast("int").alias("parts"),
            F.ceil(F.col("n") / CHUNK).alias("chunks"),
        )
        large = written(large, "large-cells")
        if large.isEmpty():
            break
        before, rows = rows, _split(rows, large, level, reach, kind)
        discard(before)
    return rows


def _links(rows: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(id, links, root): of each block, a vector's links with ids of one vector, and the smallest id that it reaches.

    Where an id of several vectors is at one end, (id, links, null, other) tells the pair, links being what it counts.
    """

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        x, y = int(key[3]), int(key[4])
        own = group["block"].to_numpy()
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        empty = pd.DataFrame({c: pd.Series(dtype="Int64") for c in ("id", "links", "root", "other")})
        if not len(left) or not len(right):
            return empty
        unit_rows = points(group, kind)
        mask = unit_rows[left] @ unit_rows[right].T >= threshold
        ids, weight, several, guest = (group[c].to_numpy() for c in ("id", "weight", "several", "guest"))
        mask &= (ids[left][:, None] != ids[right][None, :]) & (guest[left][:, None] & guest[right][None, :] == 0)
        left, right, mask = left[mask.any(axis=1)], right[mask.any(axis=0)], mask[mask.any(axis=1)][:, mask.any(axis=0)]
        if not len(left):
            return empty
        rows, columns = forest(mask, ids[left], ids[right])
        counted = np.where(several, 0, weight)
        out = [pd.DataFrame({"id": ids[left], "links": mask @ counted[right], "root": rows})]
        if x != y:
            out.append(pd.DataFrame({"id": ids[right], "links": mask.T @ counted[left], "root": columns}))
        if several.any():
            i, j = np.nonzero(mask & (several[left][:, None] | several[right][None, :]))
            i, j = left[i], right[j]
            i, j = (np.concatenate([i, j]), np.concatenate([j, i])) if x != y else (i, j)
            told = several[i] | several[j]
            out.append(pd.DataFrame({"id": ids[i], "links": np.where(several[j], 1, weight[j]), "other": ids[j]})[told])
        out = pd.concat(out, ignore_index=True)
        return out.reindex(columns=["id", "links", "root", "other"]).astype("Int64")

    blocks = rows.groupBy(*PLACE).agg(
        F.ceil(F.count_if(~F.col("visits")) / BLOCK).cast("int").alias("members"),
        F.ceil(F.count_if("visits") / BLOCK).cast("int").alias("visitors"),
    )
    dealt = rows.join(blocks.where("members > 0"), PLACE)
    mine = F.pmod(F.xxhash64("id", "vector"), F.when(F.col("visits"), F.col("visitors")).otherwise(F.col("members"))).cast("int")
    dealt = dealt.withColumn("block", mine + F.when(F.col("visits"), F.col("members")).otherwise(F.lit(0)))
    others = F.sequence(
        F.lit(0), F.when(F.col("visits"), F.col("members") - 1).otherwise(F.col("members") + F.col("visitors") - 1)
    )
    dealt = dealt.withColumn("other", F.explode(others))
    ends = [F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")]
    dealt = dealt.select("id", "weight", "several", "guest", "vector", *PLACE, "block", *ends)
    return written(grouped(dealt.groupBy(*PLACE, "x", "y"), compare, _LINK), "links")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors``."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    embedding = F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), embedding.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(valid & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rest = rows.where(~(valid & F.col("vec_id").isNotNull() & F.col("label").isNotNull())).select("vec_id")

    digest = F.xxhash64("label", "embedding")
    repeated = good.groupBy("vec_id").agg(F.min(digest).alias("x"), F.max(digest).alias("y")).where("x != y")
    repeated = written(repeated.select("vec_id"), "several-vectors")
    n_repeated = repeated.count()
    listed = _small(repeated, n_repeated)
    single = good.join(listed, "vec_id", "left_anti") if n_repeated else good
    distinct = single.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("weight")
    ).withColumn("several", F.lit(False))
    if n_repeated:
        more = good.join(listed, "vec_id", "left_semi").select("label", "embedding", F.col("vec_id").alias("id")).distinct()
        distinct = distinct.unionByName(more.withColumn("weight", F.lit(1).cast("long")).withColumn("several", F.lit(True)))
    distinct = written(distinct, "distinct-vectors")
    cells = _cells(distinct, threshold, kind)
    compared = _links(cells, threshold, kind)
    discard(cells)

    links = compared.where(F.col("other").isNull()).groupBy("id").agg(F.sum("links").alias("links"))
    pairs = compared.where(F.col("other").isNotNull()).select("id", "other", "links").distinct()
    pairs = pairs.groupBy("id").agg(F.sum("links").alias("pairs"))
    grouped_ids = components(compared.where(F.col("other").isNull()).select(F.col("id").alias("a"), F.col("root").alias("b")))
    found = distinct.where("not several").join(links, "id", "left").join(grouped_ids, "id", "left")
    found = found.join(pairs, "id", "left") if n_repeated else found.withColumn("pairs", F.lit(None).cast("long"))
    classes = found.select(
        "label",
        "embedding",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1 + F.coalesce("pairs", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    columns = ["vec_id", "n_links", "component_id"]
    out = single.join(classes, ["label", "embedding"]).select(columns)
    if n_repeated:
        of_several = repeated.withColumnRenamed("vec_id", "id").join(pairs, "id", "left").join(grouped_ids, "id", "left")
        of_several = of_several.select(
            F.col("id").alias("vec_id"), F.coalesce("pairs", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component_id")
        )
        out = out.unionByName(good.select("vec_id").join(of_several, "vec_id").select(columns))
    # A row without a usable vector has the result of its id's other rows, if there are any.
    by_id = out.join(rest.distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rest = rest.join(by_id, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
