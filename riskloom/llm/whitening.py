"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Every remaining entry c becomes the whole number x = floor(1024 * c) + 100000. Three passes over the vectors, without a
shuffle of them: (1) counts and per-dimension sums S; (2) the scatter of z = x - floor(S / n), which is centred before it is
multiplied and summed exactly in whole numbers, so that the order of tasks changes nothing (what the floor leaves, r = S -
n * floor(S / n), is taken off exactly afterwards: n * n * V = n * sum(z z') - r r'); (3) the projection of every row. Tasks
send one row for each pair of dimensions, so what is shuffled and what reaches the driver is bounded by the dimension
(``MAX_DIM``), not by the rows.

V = L L' with pivoting, where L has as many columns as V has rank; rotating pairs of L's columns until all are orthogonal
gives L J = U diag(s), whose squared column norms are V's eigenvalues and whose normalised columns are its eigenvectors, to
the relative accuracy of the factor and without forming another product. Signs: a component's largest entry is positive.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped, and so are empty vectors and those
that have not the most common length (of equally common ones the largest); a null id stays null and repeated ids and equal
vectors are rows of their own; no remaining row, or equal vectors alone, have no component and give no row; entries of 2**40
and more raise. ``whiten`` keeps all columns of the input, renamed to ``in_<name>`` where it adds one of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import make_room, table, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
MAX_DIM = 4096
_MOST = 1 << 40
_EXACT = 1 << 53  # whole numbers below are exact as doubles


@dataclass(frozen=True)
class Whitening:
    """A fitted model: x is centred by ``mean + rest / n``; ``components`` (dimension x rank), eigenvalues falling."""

    n: int
    mean: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): v[order][:, order] = L L', L lower trapezoidal with as many columns as v has rank in double precision."""
    d = len(v)
    a, order, columns = v.copy(), np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(np.max(np.diag(v), initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(np.diag(a)[k:]))
        if not a[p, p] > least:
            return columns[:, :k], order
        for m in (a, columns, order):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        columns[k:, k] = a[k:, k] / np.sqrt(a[k, k])
        a[k + 1 :, k + 1 :] -= np.outer(columns[k + 1 :, k], columns[k + 1 :, k])
    return columns, order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """``factor`` with its columns rotated in pairs until all are orthogonal. The pairs of a round share no column (a
    round-robin), so each round is a few operations on whole arrays."""
    a, r = factor.copy(), factor.shape[1]
    if r < 2:
        return a
    table_ = list(range(r)) + [None] * (r % 2)
    half = len(table_) // 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(table_) - 1):
            pairs = [(i, j) for i, j in zip(table_[:half], table_[: half - 1 : -1], strict=True) if i is not None and j is not None]
            table_ = [table_[0], table_[-1], *table_[1:-1]]
            i, j = (np.array(x) for x in zip(*pairs, strict=True))
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            apart = np.abs(xy) / np.sqrt(xx * yy)
            worst = max(worst, float(apart.max()))
            turn = apart > 1e-16
            zeta = (yy - xx) / np.where(turn, 2 * xy, 1)
            t = np.where(turn, np.copysign(1.0, zeta) / (np.abs(zeta) + np.hypot(1, zeta)), 0.0)
            c = 1 / np.hypot(1, t)
            a[:, i], a[:, j] = c * x - c * t * y, c * t * x + c * y
        if worst <= 4e-16 * np.sqrt(len(a)):
            break
    return a


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, eigenvalues) of a symmetric positive semidefinite matrix, falling, as far as its rank."""
    factor, order = pivoted_cholesky(v)
    turned = one_sided_jacobi(factor)
    values = (turned * turned).sum(0)
    rank = np.argsort(-values, kind="stable")
    columns = np.empty_like(turned)
    columns[order] = turned
    columns = columns[:, rank] / np.sqrt(values[rank])
    signs = np.sign(columns[np.argmax(np.abs(columns), axis=0), np.arange(len(rank))]) if len(rank) else np.ones(0)
    return columns * signs, values[rank]


def _vector(column: str) -> Column:
    return F.col(column).cast("array<double>")


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has an entry, and only finite ones."""
    fine = F.forall(_vector(column), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where((F.size(column) > 0) & fine)


def _whole(values: np.ndarray) -> np.ndarray:
    if values.size and np.abs(values).max() >= _MOST:
        raise ValueError("an entry of 2**40 or more")
    return np.floor(values * SCALE).astype(np.int64) + SHIFT


def _entries(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length of vectors: their number and the sums of their entries."""
    found: dict[int, list] = {}
    for batch in batches:
        column = batch.column(0)
        lengths = np.asarray(column.value_lengths())
        x, starts = _whole(_entries(column)), np.cumsum(lengths) - lengths
        for size in np.unique(lengths).tolist():
            at = starts[lengths == size]
            total = x[at[:, None] + np.arange(size)].sum(0).tolist()
            n, before = found.get(size, (0, [0] * size))
            found[size] = [n + len(at), [a + b for a, b in zip(before, total, strict=True)]]
    for size, (n, total) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), _decimals(total)], ["size", "pos", "n", "total"]
        )


def _product(z: np.ndarray) -> np.ndarray:
    """z' z in whole numbers, by way of doubles where those are exact."""
    most = int(np.abs(z).max(initial=0))
    if most * most * len(z) < _EXACT:
        z = z.astype(float)
        return (z.T @ z).astype(np.int64).astype(object)
    z = z.astype(object)
    return z.T @ z


def _scatter(mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, total = len(mean), 0
        for batch in batches:
            if batch.num_rows:
                total = total + _product(_whole(_entries(batch.column(0))).reshape(-1, d) - mean)
        if not isinstance(total, int):
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _decimals(total[i, j])], ["i", "j", "total"])

    return run


def fit(vectors: DataFrame, column: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors; None where no row is left or all are equal."""
    rows = usable(vectors, column).select(_vector(column).alias("v"))
    sums = rows.mapInArrow(_sums, "size int, pos int, n long, total decimal(38,0)").groupBy("size", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    sums = written(sums, "sums")
    common = sums.where("pos = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return None
    n, d = common["n"], common["size"]
    if d > MAX_DIM:
        raise ValueError(f"vectors of {d} entries; the scatter is kept for {MAX_DIM} at most")
    sums = np.array([int(r["total"]) for r in sums.where(F.col("size") == d).orderBy("pos").collect()], object)
    mean = np.array([s // n for s in sums], np.int64)
    rest = sums - n * mean.astype(object)
    pairs = rows.where(F.size("v") == d).mapInArrow(_scatter(mean), "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total"))
    v = np.zeros((d, d))
    for i, j, total in pairs.collect():
        v[i, j] = v[j, i] = (n * int(total) - rest[i] * rest[j]) / (n * n)
    if not v.any():
        return None
    components, eigenvalues = eigen(v)
    return Whitening(n, mean, rest, components, eigenvalues, float(np.trace(v)))


def _project(model: Whitening, k: int):
    n, d, mean = model.n, len(model.mean), model.mean
    part = (model.rest / n).astype(float)
    onto = model.components[:, :k] / np.sqrt(model.eigenvalues[:k])
    count = onto.shape[1]

    def deviations(z: np.ndarray) -> list[int]:
        most = n * (int(np.abs(z).max(initial=0)) + 1)
        kind = np.int64 if d * most * most < 1 << 62 else object
        y = n * z.astype(kind) - model.rest.astype(kind)
        return (y * y).sum(1).tolist()

    @F.arrow_udf("struct<whitened: array<double>, deviation: decimal(38,0)>")
    def project(vectors: pa.Array) -> pa.Array:
        z = _whole(_entries(vectors)).reshape(-1, d) - mean
        w = (z - part) @ onto
        whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * count, pa.int32()), pa.array(w.ravel()))
        return pa.StructArray.from_arrays([whitened, _decimals(deviations(z))], ["whitened", "deviation"])

    return project


def whiten(vectors: DataFrame, model: Whitening, k: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """The usable rows with ``whitened`` (one value for each of the first ``k`` components) and ``deviation``, the exact
    squared distance of n * x from S."""
    rows = make_room(usable(vectors, column).where(F.size(column) == len(model.mean)), "whitened", "deviation")
    own = column if column in rows.columns else f"in_{column}"
    got = _project(model, k)(_vector(own))
    return rows.withColumn("__got", got).withColumns({c: F.col("__got")[c] for c in ("whitened", "deviation")}).drop("__got")


def identity_error(rows: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` less the identity; products are centred by each task."""
    w = [F.col("whitened")[i] for i in range(k)]
    found = rows.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row of ``embeddings`` whitened onto eight components, with exact deviations."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors)
    if model is None:
        return spark.createDataFrame([], _RESULT)
    k = min(COMPONENTS, len(model.eigenvalues))
    rows = written(whiten(vectors, model, k).select("vec_id", "deviation", "whitened"), "whitened")
    error = identity_error(rows, k)
    each = rows.select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*[F.lit(float(x)) for x in model.explained[:k]]), F.col("at") + 1)
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
