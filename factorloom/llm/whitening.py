"""Whitening of embeddings by shifted CholeskyQR.

Vectors are put on a grid of whole numbers, so that equal vectors are equal and sums are exact. Over the distinct vectors A, centred,
a pass adds up the Gram matrix of A R1^-1 R2^-1 ..., with one triangular solve for each factor found so far, and the driver takes
the next factor from it by Cholesky: with a shift where the matrix is too near to singular, so that no direction is lost and those
without variance shrink. Once the rows are orthonormal, A = Q R with R the product of all factors, and the singular value
decomposition of R gives the components of A.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import materialise, schema_with

#: steps of the grid in one unit
GRID = 256
#: passes at most (three to four where all directions vary), and bytes of centred rows that a task holds at once
PASSES, CHUNK_BYTES = 10, 8 << 20

UNIT = 2.0**-53
LONGEST = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: size and exact sums of the fit list, unit components as rows by falling eigenvalue."""

    n: int
    sums: np.ndarray  # Python integers
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def dims(self) -> int:
        return len(self.sums)


def on_grid(vector: Column) -> Column:
    """The vector's grid point (array of longs); null for a null vector and for null or non-finite entries."""
    c = vector.cast("array<double>")
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(c.isNotNull() & whole, F.transform(c, lambda v: F.floor(v * GRID)))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def offsets(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: 64-bit where all fit, else Python integers."""
    most = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max((abs(s) for s in sums), default=0)
    if most < 2**62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def deviations(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row; None where one doesn't fit 64 bits."""
    rough = (d.astype(float) ** 2).sum(axis=1)
    if d.dtype != object:
        u = d.view(np.uint64)
        wrapped = (u * u).sum(axis=1, dtype=np.uint64)  # exact modulo 2^64
    out: list[int | None] = []
    for i, r in enumerate(rough):
        if d.dtype != object and r < 0.9 * LONGEST:
            out.append(int(wrapped[i]))
        else:
            exact = sum(int(v) ** 2 for v in d[i]) if r < 1.1 * LONGEST else LONGEST + 1
            out.append(exact if exact <= LONGEST else None)
    return out


def solve_right(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows R^-1 for an upper triangular R, by forward substitution over the columns."""
    q = np.ascontiguousarray(rows.T)
    for j in range(len(r)):
        if j:
            q[j] -= r[:j, j] @ q[:j]
        q[j] /= r[j, j]
    return q.T


def chunks(x: np.ndarray) -> Iterator[np.ndarray]:
    step = max(1, CHUNK_BYTES // (8 * max(1, x.shape[1])))
    for at in range(0, len(x), step):
        yield x[at : at + step]


def summed(fit: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of a square matrix ``of`` (chunk of grid points) over the fit list: added up in each task, then by entry.

    A task sends one triangle, the driver gets one: their size depends on the dimensions only.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in chunks(matrix(batch.column(0), dims)):
                part = of(x)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    cells = fit.select("x").mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = 1 + max(c.i for c in cells)
    out = np.zeros((size, size))
    for c in cells:
        out[c.i, c.j] = out[c.j, c.i] = c.v
    return out


def exact_sums(fit: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Rows of the fit list and the exact sum of each dimension, through halves that can't overflow."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            n += len(x)
            total += (x >> 32).sum(axis=0).astype(object) * 2**32 + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([int(t) >> 32 for t in total], pa.int64()), pa.array([int(t) & 0xFFFFFFFF for t in total], pa.int64())], names=["i", "n", "high", "low"])

    rows = fit.select("x").mapInArrow(add, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    sums = np.zeros(dims, object)
    for r in rows:
        sums[r.i] = r.high * 2**32 + r.low
    return rows[0].n, sums


def triangular_factor(gram: np.ndarray, n: int, shift: bool) -> np.ndarray:
    """R with R'R = gram, shifted by 11 (n d + d (d + 1)) u |gram| if asked or needed, and more if that isn't enough."""
    d = len(gram)
    s = min(1e-6, 11 * (n * d + d * (d + 1)) * UNIT) * max(np.trace(gram), np.finfo(float).tiny * 2**60)
    if not shift and np.linalg.eigvalsh(gram)[0] > 1e-6:
        return np.linalg.cholesky(gram).T
    while True:
        try:
            return np.linalg.cholesky(gram + s * np.eye(d)).T
        except np.linalg.LinAlgError:
            s *= 10


def fit_whitening(df: DataFrame, vector_col: str = "embedding", components: int = 4) -> Whitening:
    """Fit the first ``components`` components to the distinct grid points of a table's vectors.

    Vectors of another length than most rows have (ties: the longer) lack or exceed entries and don't count. Components without
    variance don't exist, so there may be fewer, or none: a table that is empty, or whose vectors are all alike or empty, has none.
    The driver and each task hold square matrices of the dimensions, the driver ten at most.
    """
    each = materialise(df.select(on_grid(F.col(vector_col)).alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("copies")))
    usual = each.groupBy(F.size("x").alias("dims")).agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), F.desc("dims")).first()
    dims = usual.dims if usual else 0
    if not dims:
        return Whitening(0, np.zeros(0, object), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0)
    fit = each.where(F.size("x") == dims).select("x")
    n, sums = exact_sums(fit, dims)

    def orthogonalised(factors: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        def gram(x: np.ndarray) -> np.ndarray:
            q = offsets(x, n, sums).astype(float) / n
            for r in factors:
                q = solve_right(q, r)
            return q.T @ q

        return gram

    factors: list[np.ndarray] = []
    whole, trace = np.eye(dims), 0.0
    while True:
        gram = summed(fit, dims, orthogonalised(factors))
        if not factors:
            trace = float(np.trace(gram))
            if trace <= 0:
                return Whitening(n, sums, np.zeros((0, dims)), np.zeros(0), 0.0, 0.0, 1)
        u, values, axes = np.linalg.svd(whole)
        kept = min(components, int((values > 32 * dims * UNIT * values[0]).sum()))
        # how far R'R is from the product of A with itself, seen from the components that are kept
        weight = np.minimum(1, values / values[kept - 1])
        off = np.abs(u.T @ (gram - np.eye(dims)) @ u) * np.outer(weight, weight)
        if factors and (off.max() < 1e-13 * dims or len(factors) == PASSES):
            break
        factors.append(triangular_factor(gram, n, shift=not factors))
        whole = factors[-1] @ whole
    axes = axes[:kept] * np.sign(axes[np.arange(kept), np.abs(axes[:kept]).argmax(axis=1)])[:, None]
    eigenvalues = values[:kept] ** 2 / n
    scaled = (axes / np.sqrt(eigenvalues)[:, None]).T

    def covariance(x: np.ndarray) -> np.ndarray:
        w = offsets(x, n, sums).astype(float) / n @ scaled
        return w.T @ w

    error = float(np.abs(summed(fit, dims, covariance) / n - np.eye(kept)).max())
    return Whitening(n, sums, axes, eigenvalues, trace / n, error, len(factors) + 1)


def whiten(df: DataFrame, model: Whitening, vector_col: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """A row for each vector and component: ``keep``, component (from 1), n, deviation, whitened, explained, identity_error.

    deviation is the sum of (n x - S)^2 over the dimensions, exact, and null where it exceeds 64 bits. Rows whose vector is null, holds null
    or non-finite entries or has not the model's length are dropped; repeated rows and null ids stay; entries beyond 64 bits on the grid are put at
    its end. Every component has the sign that makes its largest entry positive. A model without components, or an empty
    table, gives no rows. Other columns of ``df`` aren't read.
    """
    n, sums, dims, kept = model.n, model.sums, model.dims, len(model.eigenvalues)
    scaled = (model.components / np.sqrt(model.eigenvalues)[:, None]).T
    explained, error = model.eigenvalues / model.trace if kept else np.zeros(0), model.identity_error

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in chunks(matrix(batch.column(batch.num_columns - 1), dims)):
                d = offsets(x, n, sums)
                rows = np.repeat(np.arange(at, at + len(x)), kept)
                at += len(x)
                tile = lambda v, t: pa.array(np.tile(v, len(x)), t)  # noqa: B023, E731
                ids = [c.take(pa.array(rows)) for c in batch.columns[:-1]]
                whitened = (d.astype(float) / n @ scaled).reshape(-1)
                deviation = pa.array(deviations(d), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), kept)))
                values = [tile(np.arange(1, kept + 1), pa.int32()), pa.array(np.full(len(rows), n)), deviation, pa.array(whitened), tile(explained, pa.float64()), pa.array(np.full(len(rows), error))]
                yield pa.RecordBatch.from_arrays([*ids, *values], names=[*batch.schema.names[:-1], "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = schema_with(df, keep, "component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not kept:
        return df.sparkSession.createDataFrame([], schema)
    return df.select(*keep, on_grid(F.col(vector_col)).alias("_x")).where(F.size("_x") == dims).mapInArrow(project, schema)
