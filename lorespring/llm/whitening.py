"""Whitening of vectors by Chebyshev-filtered subspace iteration.

Each entry c of a vector becomes the whole number floor(64 * c) + 1,000,000; the model is fitted to the distinct vectors
of these, which are written once as packed blocks. A pass over the blocks multiplies the centred vectors with a narrow
matrix, X'(XQ); only such a product, as wide as a vector and ``COMPONENTS + EXTRA`` columns at most, comes to the driver,
added up in groups of tasks first. A few Lanczos steps bound the spectrum from below. Then a Chebyshev polynomial of the
covariance, by its three-term recurrence, damps the unwanted part of the spectrum; QR and Rayleigh-Ritz follow, until
the residuals of all wanted components are certified: at rounding error, and no longer falling.

Defined results: a vector that is null, empty, or holds a null, a non-finite entry or one of 2**40 or more in size has
no rows; vectors of each width are whitened for themselves; repeated rows get equal results, and count once in the fit;
a null vec_id is kept as it is; components of no variance (a millionth of a millionth of the largest, or less) are left
out, so a single distinct vector has none; a deviation that no long holds is null; an empty table gives no rows. Only
vec_id and embedding are read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespring.llm.common import discard, mapped, written

SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 40)
COMPONENTS, EXTRA = 16, 16
#: Lanczos steps that bound the spectrum, the highest degree of the filter, and the most that it may raise one component over another.
STEPS, DEGREE, CONTRAST = 6, 12, 1e9
#: Residuals that count as certified once they fall no more, as a share of the largest eigenvalue; rounds until it is an error.
CERTIFIED, ROUNDS = 1e-11, 200
#: Products that come to the driver without being added up in groups first, and the number of groups.
PARTS, GROUPS = 64, 32
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Model:
    """What a width's vectors are whitened with: n and the sums S of the fit, and a column of ``weights`` a component."""

    n: int
    sums: np.ndarray
    weights: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the usable vectors."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    usable = (F.size("e") > 0) & F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    rows = rows.where(F.coalesce(usable, F.lit(False)))
    return rows.select("vec_id", F.transform("e", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a batch as one matrix a width, each with the rows that it holds."""
    width, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    starts = np.cumsum(width) - width
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        yield at, values[starts[at][:, None] + np.arange(w)[None, :]]


def _packed(distinct: DataFrame) -> DataFrame:
    """The distinct vectors in blocks (width, n, x)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(m.shape[1], len(m), m.astype("<i8").tobytes()) for _, m in _matrices(batch.column("x"))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["width", "n", "x"])

    return mapped(distinct, pack, "width int, n int, x binary")


class Passes:
    """Passes over the blocks of one width; ``count`` tells how many were made."""

    def __init__(self, blocks: DataFrame, width: int, n_blocks: int):
        self.blocks, self.width, self.count, self.many = blocks, width, 0, n_blocks > PARTS
        self.n, self.sums, self.mean = 0, np.zeros(width, dtype=np.int64), np.zeros(width)
        self.n, self.sums = self._sums()

    def _each(self, function: Callable[[np.ndarray], object], pack: Callable, schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for data, n in zip(batch.column("x"), batch.column("n"), strict=True):
                    x = np.frombuffer(data.as_buffer(), dtype="<i8").reshape(n.as_py(), -1)
                    value = function(x)
                    total = value if total is None else total + value
            if total is not None:
                part = pa.array([TaskContext.get().partitionId()], pa.int32())
                yield pa.RecordBatch.from_arrays([part, pa.array([pack(total)])], names=["part", "value"])

        return mapped(self.blocks, run, schema)

    def _sums(self) -> tuple[int, np.ndarray]:
        """The number of vectors and their sum in each dimension, exact; whole numbers of any size on the way."""
        rows = self._each(
            lambda x: np.array([len(x), *x.sum(axis=0).tolist()], dtype=object), lambda t: json.dumps([int(v) for v in t]), "part int, value string"
        )
        total = [sum(v) for v in zip(*(json.loads(r.value) for r in self._grouped_sums(rows)), strict=True)]
        return total[0], np.array(total[1:], dtype=object)

    def _grouped_sums(self, rows: DataFrame) -> list:
        if not self.many:
            return rows.collect()

        def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            added = [sum(v) for v in zip(*map(json.loads, group["value"]), strict=True)]
            return pd.DataFrame({"part": [key[0]], "value": [json.dumps(added)]})

        return rows.groupBy((F.col("part") % GROUPS).alias("part")).applyInPandas(add, "part int, value string").collect()

    def total(self, function: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all blocks of a function of the centred vectors."""
        n, sums = self.n, self.sums
        self.count += 1
        rows = self._each(lambda x: function(centred(x, n, sums)), lambda t: np.ascontiguousarray(t, dtype="<f8").tobytes(), "part int, value binary")
        if self.many:

            def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
                group = group.sort_values("part")
                return pd.DataFrame({"part": [key[0]], "value": [sum(np.frombuffer(v, dtype="<f8") for v in group["value"]).tobytes()]})

            rows = rows.groupBy((F.col("part") % GROUPS).alias("part")).applyInPandas(add, "part int, value binary")
        return sum(np.frombuffer(r.value, dtype="<f8") for r in sorted(rows.collect(), key=lambda r: r.part))

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times ``q``."""
        return self.total(lambda x: x.T @ (x @ q)).reshape(q.shape) / self.n


def spread(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S as whole numbers, of any size where a long might not do."""
    if n * max(int(np.abs(x).max()), SHIFT) < 1 << 61:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (spread(x, n, sums) / n).astype(np.float64)


def lower_bound(passes: Passes, start: np.ndarray) -> float:
    """A bound below the spectrum, from a few Lanczos steps; never below 0."""
    q, before, beta, alphas, betas = start / np.linalg.norm(start), np.zeros_like(start), 0.0, [], []
    for _ in range(STEPS):
        w = passes.times(q[:, None])[:, 0] - beta * before
        alphas.append(float(q @ w))
        w -= alphas[-1] * q
        beta = float(np.linalg.norm(w))
        if beta <= 1e-12 * max(abs(alphas[0]), 1e-300):
            return 0.0
        betas.append(beta)
        before, q = q, w / beta
    ritz = np.linalg.eigvalsh(np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1))
    return max(0.0, float(ritz[0]) - beta)


def _ritz(passes: Passes, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, their vectors in the span of ``q``, and the covariance times these."""
    product = passes.times(q)
    small = q.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, product @ turn


def _degree(top: float, least: float) -> int:
    """The highest degree whose filter raises ``top`` over ``least``, both in units of the damped half-width, by CONTRAST at most."""
    degree = 1
    while degree < DEGREE and np.cosh((degree + 1) * np.arccosh(top)) <= CONTRAST * np.cosh((degree + 1) * np.arccosh(max(least, 1.0))):
        degree += 1
    return degree


def filtered(passes: Passes, values: np.ndarray, q: np.ndarray, product: np.ndarray, low: float) -> np.ndarray:
    """An orthonormal basis of a Chebyshev polynomial of the covariance times ``q``, small between ``low`` and the last Ritz value."""
    edge = float(values[-1])
    low = min(low, 0.95 * edge)
    middle, half = (edge + low) / 2, (edge - low) / 2
    if edge <= 1e-9 * values[0]:
        return np.linalg.qr(product)[0]  # all the variance lies in fewer dimensions than q spans
    wanted = values[: min(COMPONENTS, len(values))]
    degree = _degree((values[0] - middle) / half, (wanted[-1] - middle) / half)
    before, now = q, (product - middle * q) / half
    for _ in range(degree - 1):
        before, now = now, 2 * (passes.times(now) - middle * now) / half - before
    now = now / np.linalg.norm(now, axis=0)
    return np.linalg.qr(now)[0]


def principal(passes: Passes, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of the covariance, falling, and their unit eigenvectors as columns."""
    width = passes.width
    columns = min(width, components + EXTRA)
    if columns == width:
        values, q, _ = _ritz(passes, np.eye(width))
        return values[:components], q[:, :components]
    random = np.random.default_rng(7)
    q = np.linalg.qr(random.standard_normal((width, columns)))[0]
    low = lower_bound(passes, random.standard_normal(width))
    last = np.inf
    for _ in range(ROUNDS):
        values, q, product = _ritz(passes, q)
        if values[0] <= 0:
            return values[:0], q[:, :0]
        apart = np.linalg.norm(product - q * values, axis=0)[:components].max() / values[0]
        if apart <= CERTIFIED and apart >= last / 4:
            return values[:components], q[:, :components]
        last = apart
        q = filtered(passes, values, q, product, low)
    raise ArithmeticError(f"components are not certified after {ROUNDS} rounds: residual {last:.1e} of the largest eigenvalue")


def fitted(blocks: DataFrame, width: int, n_blocks: int, components: int = COMPONENTS) -> Model:
    """The model of one width, with the largest difference of the whitened covariance from the identity."""
    passes = Passes(blocks.where(F.col("width") == width), width, n_blocks)
    values, q = principal(passes, components)
    trace = float(passes.total(lambda x: np.array([(x * x).sum()]))[0]) / passes.n
    held = values > 1e-12 * max(float(values[0]) if len(values) else 0.0, 1e-300)
    model = Model(passes.n, passes.sums, q[:, held] / np.sqrt(values[held]), values[held] / trace if trace > 0 else values[held])
    if held.any():
        weights = model.weights

        def moments(x: np.ndarray) -> np.ndarray:
            z = x @ weights
            return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

        found = passes.total(moments) / passes.n
        m, k = found[: weights.shape[1]], weights.shape[1]
        model.identity_error = float(np.abs(found[k:].reshape(k, k) - np.outer(m, m) - np.eye(k)).max())
    return model


def _deviations(far: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact."""
    if far.dtype != object and float(np.abs(far).max()) ** 2 * far.shape[1] < 2.0**62:
        return (far * far).sum(axis=1).tolist()
    exact = (sum(int(v) * int(v) for v in row) for row in far)
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    rows = whole_vectors(vectors)
    blocks = written(_packed(rows.select("x").distinct()), "vector-blocks")
    sizes = blocks.groupBy("width").count().collect()
    models = {r.width: fitted(blocks, r.width, r["count"], components) for r in sizes}
    discard(blocks)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for at, x in _matrices(batch.column("x")):
                model = models[x.shape[1]]
                k = model.weights.shape[1]
                if not k:
                    continue
                far = spread(x, model.n, model.sums)
                z = (far / model.n).astype(np.float64) @ model.weights
                each = np.repeat(np.arange(len(at)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(at[each])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(each), model.n, dtype=np.int64)),
                        pa.array(_deviations(far), pa.int64()).take(pa.array(each)),
                        pa.array(z.ravel()),
                        pa.array(np.tile(model.explained, len(at))),
                        pa.array(np.full(len(each), model.identity_error)),
                    ],
                    names=[c.split()[0] for c in _OUT.split(", ")],
                )

    return mapped(rows, apply, _OUT)
