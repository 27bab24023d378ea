"""Exact nearest neighbours of a set of query vectors, and what ranks and verdicts build on their scores.

Both sides are packed into blocks of bounded size in the tasks that scan them; one matrix product scores a block of
queries against a block of rows. Where the queries are few, their blocks are broadcast and the rows stay where they are;
where they are many, both sides are dealt to groups of bounded size, each query group meeting each row group once. A
task passes on the best k of each query, so what is shuffled afterwards is k rows a query and task, however many rows
there are. No vector passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespring.operators.steps import bounded_batches, release, written

#: Vectors of a block, and bytes of its vectors, at most; a product of two blocks holds several tables of their pairs.
BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20
#: Bytes of query vectors that are broadcast; more are dealt to groups of so many bytes on either side.
BROADCAST_BYTES, GROUP_BYTES = 32 << 20, 32 << 20
#: Rows of one bucket of scopes on average, and groups of blocks that are broadcast as a table of sizes.
BUCKET_ROWS, BROADCAST_ROWS = 16_384, 100_000
#: What stands for null among whole numbers in a block.
MISSING = np.iinfo(np.int64).min

FULL, PARTIAL = 0.60, 0.35
Attributes = dict[str, np.ndarray]


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; -1 where either vector is zero."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(-1.0)).otherwise(dot(a, b) / norms)


def cosine_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of each query with each row; -1 where either is zero. Higher is nearer."""
    q, r = np.linalg.norm(queries, axis=1), np.linalg.norm(rows, axis=1)
    norms = q[:, None] * r[None, :]
    return np.where(norms == 0, -1.0, queries @ rows.T / np.where(norms == 0, 1.0, norms))


def l2_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distance of each query and each row. Lower is nearer."""
    square = (queries**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None, :] - 2 * queries @ rows.T
    return np.maximum(square, 0.0)


def _usable(df: DataFrame) -> DataFrame:
    """The rows whose vector is there, has entries and no null among them."""
    return df.where(F.coalesce((F.size("vector") > 0) & ~F.exists("vector", lambda c: c.isNull()), F.lit(False)))


def widths(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(width, n_queries, n_rows): vectors meet only those of their own width; null for vectors that take no part."""
    width = F.when(F.coalesce((F.size("vector") > 0) & ~F.exists("vector", lambda c: c.isNull()), F.lit(False)), F.size("vector"))
    one = lambda df, name: df.groupBy(width.alias("width")).agg(F.count("*").alias(name))
    asked, held = one(queries, "n_queries"), one(rows, "n_rows")
    both = asked.join(held.withColumnRenamed("width", "other"), F.col("width").eqNullSafe(F.col("other")), "full")
    zero = F.lit(0).cast("long")
    return both.select(F.coalesce("width", "other").alias("width"), F.coalesce("n_queries", zero).alias("n_queries"), F.coalesce("n_rows", zero).alias("n_rows"))


def _packed(df: DataFrame, names: list[str], bucket: Column) -> DataFrame:
    """Blocks (width, bucket, n, vectors, and the packed whole numbers of each column in ``names``)."""
    kind = "<f4" if df.schema["vector"].dataType.elementType.typeName() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            width, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            starts = np.cumsum(width) - width
            numbers = [batch.column(c).fill_null(int(MISSING)).to_numpy() for c in names]
            key = np.stack([width, batch.column("bucket").to_numpy()])
            for w, b in np.unique(key, axis=1).T.tolist():
                all_at, most = np.flatnonzero((key[0] == w) & (key[1] == b)), max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * w)))
                for at in np.split(all_at, range(most, len(all_at), most)):
                    vectors = values[starts[at][:, None] + np.arange(w)[None, :]].astype("<f8")
                    packed = [vectors.tobytes(), *(n[at].astype("<i8").tobytes() for n in numbers)]
                    columns = [pa.array([x], pa.int32()) for x in (w, b, len(at))] + [pa.array([x]) for x in packed]
                    yield pa.RecordBatch.from_arrays(columns, names=["width", "bucket", "n", "vectors", *(f"of_{c}" for c in names)])

    schema = "width int, bucket int, n int, vectors binary, " + ", ".join(f"of_{c} binary" for c in names)
    whole = [F.col(c).cast("long").alias(c) for c in names]
    vector = F.col("vector") if kind == "<f4" else F.col("vector").cast("array<double>").alias("vector")
    return _usable(df).select(vector, bucket.cast("int").alias("bucket"), *whole).mapInArrow(run, schema)


class _Best:
    """The best k rows of each query of a block, over any number of row blocks."""

    def __init__(self, k: int, scores: Callable, sign: float, admits: Callable | None, ties: Callable | None, within: str | None, by: str | None):
        self.k, self.scores, self.sign, self.admits, self.ties, self.within, self.by = k, scores, sign, admits, ties, within, by
        self.held: dict[bytes, list[np.ndarray]] = {}

    def _first(self, found: list[np.ndarray]) -> list[np.ndarray]:
        """The first k of each query (and value of ``by``) of flat arrays (query, group, value, tie, id)."""
        query, group, value, tie, ids = found
        order = np.lexsort((ids, tie, value, group, query))
        found = [x[order] for x in found]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (found[0][1:] != found[0][:-1]) | (found[1][1:] != found[1][:-1])
        begin = np.flatnonzero(new)
        place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        return [x[place < self.k] for x in found]

    def add(self, name: bytes, queries: Attributes, rows: Attributes) -> None:
        """Score a block of rows for the block of queries ``name``; the best so far stay here."""
        value = self.sign * self.scores(queries["vectors"], rows["vectors"])
        allowed = ~np.isnan(value)
        if self.within:
            allowed &= (queries[self.within][:, None] == rows[self.within][None, :]) & (rows[self.within] != MISSING)[None, :]
        if self.by:
            allowed &= (rows[self.by] != MISSING)[None, :]
        if self.admits:
            allowed &= self.admits({c: x[:, None] for c, x in queries.items()}, {c: x[None, :] for c, x in rows.items()})
        columns = [np.arange(value.shape[1])] if not self.by else [np.flatnonzero(rows[self.by] == v) for v in np.unique(rows[self.by])]
        for of in columns:
            part, fits = np.where(allowed[:, of], value[:, of], np.inf), allowed[:, of]
            last = np.partition(part, min(self.k, len(of)) - 1, axis=1)[:, min(self.k, len(of)) - 1]
            i, j = np.nonzero(fits & (part <= last[:, None]))
            if not len(i):
                continue
            ids = rows["id"][of[j]]
            ties = np.zeros(len(i), dtype=np.int64)
            if self.ties:
                ties = self.ties({c: x[i] for c, x in queries.items() if c != "vectors"}, {c: x[of[j]] for c, x in rows.items() if c != "vectors"})
            group = rows[self.by][of[j]] if self.by else np.zeros(len(i), dtype=np.int64)
            found = [queries["query_id"][i], group, part[i, j], ties, ids]
            before = self.held.get(name)
            self.held[name] = self._first(found if before is None else [np.concatenate(x) for x in zip(before, found, strict=True)])

    def told(self) -> Iterator[pd.DataFrame]:
        for query, group, value, tie, ids in self.held.values():
            yield pd.DataFrame({"query_id": query, "id": ids, "score": self.sign * value, "group": group, "tie": tie})
        self.held = {}


def _unpacked(block: dict, names: list[str], prefix: str = "") -> Attributes:
    n = int(block[f"{prefix}n"])
    out = {c: np.frombuffer(block[f"{prefix}of_{c}"], dtype="<i8") for c in names}
    return out | {"vectors": np.frombuffer(block[f"{prefix}vectors"], dtype="<f8").reshape(n, -1)}


_FOUND = "query_id long, id long, score double, group long, tie long"


def _with_broadcast(queries: DataFrame, rows: DataFrame, query_names: list[str], row_names: list[str], best: Callable[[], _Best]) -> DataFrame:
    """Every row block meets the broadcast query blocks of its width, in the task that packs it."""
    asked = queries.select("width", *(F.col(c).alias(f"q_{c}") for c in queries.columns if c not in ("width", "bucket")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = best()
        for batch in batches:
            for at in range(batch.num_rows):
                pair = batch.slice(at, 1).to_pylist()[0]
                found.add(pair["q_of_query_id"], _unpacked(pair, query_names, "q_"), _unpacked(pair, row_names))
        for part in found.told():
            yield pa.RecordBatch.from_pandas(part, preserve_index=False)
        release()

    return rows.join(F.broadcast(asked), "width").mapInArrow(run, _FOUND)


def _with_groups(queries: DataFrame, rows: DataFrame, query_names: list[str], row_names: list[str], best: Callable[[], _Best]) -> DataFrame:
    """Query blocks and row blocks dealt to groups of bounded size within each width and bucket; each pair of groups is a task's."""
    spark, key = queries.sparkSession, ["width", "bucket"]
    counted = lambda df, name: df.groupBy(*key).agg(F.sum("n").alias(name))
    least = max(1, rows.agg(F.sum("n")).first()[0] or 0) // (2 * spark.sparkContext.defaultParallelism)
    most = F.greatest(F.lit(1), F.least(F.greatest(F.lit(least), F.lit(1024)), F.floor(F.lit(GROUP_BYTES) / (8 * F.col("width")))))
    sizes = counted(queries, "n_queries").join(counted(rows, "n_rows"), key)
    sizes = sizes.select(*key, F.ceil(F.col("n_queries") / most).cast("int").alias("parts"), F.ceil(F.col("n_rows") / most).cast("int").alias("other_parts"))
    sizes = written(sizes, "group-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes

    def dealt(df: DataFrame, own: str, others: str, name: str, other: str, id_name: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(f"of_{id_name}", "n"), F.col(own)).cast("int").alias(name)
        each = F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other)
        return df.join(sizes, key).select(*df.columns, mine, each)

    def meet(_key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = best()
        blocks = [_unpacked(b, row_names) for b in held.to_dict("records")]
        for block in asked.to_dict("records"):
            own = _unpacked(block, query_names)
            for other in blocks:
                found.add(block["of_query_id"], own, other)
        out = pd.concat([pd.DataFrame({c.split()[0]: [] for c in _FOUND.split(", ")}), *found.told()])
        release()
        return out

    group = [*key, "q", "r"]
    left = dealt(queries, "parts", "other_parts", "q", "r", "query_id").groupBy(*group)
    right = dealt(rows, "other_parts", "parts", "r", "q", "id").groupBy(*group)
    return left.cogroup(right).applyInPandas(meet, _FOUND)


def nearest(
    queries: DataFrame,
    rows: DataFrame,
    k: int,
    scores: Callable[[np.ndarray, np.ndarray], np.ndarray] = cosine_scores,
    descending: bool = True,
    by: str | None = None,
    within: str | None = None,
    admits: Callable[[Attributes, Attributes], np.ndarray] | None = None,
    ties: Callable[[Attributes, Attributes], np.ndarray] | None = None,
    query_columns: Sequence[str] = (),
    row_columns: Sequence[str] = (),
) -> DataFrame:
    """(query_id, id, score, rank) of the k rows nearest to each query, ties by id.

    ``queries`` has (query_id, vector) and ``rows`` (id, vector); vectors meet those of their own width (``widths``
    counts them), and vectors that are null or hold nulls take no part. ``by`` names a column of whole numbers of
    ``rows``: then the k nearest of each of its values are found in the same pass, and the column comes along; rows
    without one are left out. ``within`` names a column of whole numbers of both sides: a query meets only rows with its
    value, and rows of values that no query has are left out before they are scored. ``admits`` says which rows may be
    found at all, and ``ties`` which of equal scores comes first, from the whole numbers in ``query_columns`` and
    ``row_columns`` (``MISSING`` where null): what is not admitted never takes a place among the k.
    """
    query_names = list(dict.fromkeys(["query_id", *([within] if within else []), *query_columns]))
    row_names = list(dict.fromkeys(["id", *([within] if within else []), *([by] if by else []), *row_columns]))
    sign = -1.0 if descending else 1.0
    best = lambda: _Best(k, scores, sign, admits, ties, within, by)
    zero = F.lit(0)
    bounded_batches(queries.sparkSession)
    asked = written(_packed(queries.where(F.col(within).isNotNull()) if within else queries, query_names, zero), "query-blocks")
    size = asked.agg(F.sum(F.col("n") * F.col("width") * 8)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        if within:
            scopes = queries.select(within).distinct()
            rows = rows.join(F.broadcast(scopes), within, "left_semi")
        found = _with_broadcast(asked, _packed(rows, row_names, zero), query_names, row_names, best)
    else:
        buckets = -(-rows.count() // BUCKET_ROWS) if within else 1
        bucket = F.pmod(F.xxhash64(F.col(within).cast("long")), F.lit(max(buckets, 1))) if within else zero
        if buckets > 1:
            asked = written(_packed(queries.where(F.col(within).isNotNull()), query_names, bucket), "query-blocks")
        found = _with_groups(asked, written(_packed(rows, row_names, bucket), "row-blocks"), query_names, row_names, best)
    order = [F.desc("score") if descending else F.asc("score"), F.asc("tie"), F.asc("id")]
    out = ranked(found, ["query_id", "group"] if by else ["query_id"], *order, limit=k)
    return out.select("query_id", "id", "score", *([F.col("group").alias(by)] if by else []), "rank")


def ranked(df: DataFrame, by: list[str], *order: Column, limit: int | None = None) -> DataFrame:
    """A 1-based rank within each group, and its first ``limit`` rows only."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if limit is None else out.where(F.col("rank") <= limit)


def verdict(score: Column) -> Column:
    """FULL, PARTIAL or NONE for the best score of a query; null counts as -1."""
    score = F.coalesce(score, F.lit(-1.0))
    return F.when(score >= FULL, "FULL").when(score >= PARTIAL, "PARTIAL").otherwise("NONE")


def min_max(score: Column, by: list[str]) -> Column:
    """Scores of a group scaled to 0..1; 1 for all where they are equal."""
    window = Window.partitionBy(*by)
    low, high = F.min(score).over(window), F.max(score).over(window)
    return F.when(high == low, F.lit(1.0)).otherwise((score - low) / (high - low))
