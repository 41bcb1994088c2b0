"""Whitening of vectors: distributed covariance, a symmetric eigensolver for its leading components, projection.

Three passes run on Spark: sums of the fit list, its centred covariance as one partial matrix per task, and the
projection of every row. Only matrices of ``d x d`` numbers reach the driver, never rows. There the covariance becomes
tridiagonal by Householder reflections, bisection on Sturm counts finds the leading eigenvalues, inverse iteration finds
their vectors, and vectors of close eigenvalues are made orthogonal to each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from surveykit.llm.registry import query, table
from surveykit.session import settle

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: entries beyond this can't be scaled to exact whole numbers
LARGEST = 2.0**52
#: eigenvalues closer than this share of the largest have their vectors made orthogonal to each other
CLUSTER = 1e-3
#: eigenvalues below this share of the largest, times the dimension, are rounding of zero
RANK = 1e-14
ROWS = 4096
FIELDS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit reflection vectors of ``H a H``, ``H`` the product of Householder reflections."""
    a = np.array(a, dtype=np.float64)
    d = len(a)
    turns = []
    for k in range(d - 2):
        x = a[k + 1 :, k]
        size = np.abs(x).max()
        v = np.zeros(d)
        if size > 0:
            tail = x / size
            v[k + 1 :] = tail
            v[k + 1] += np.copysign(np.linalg.norm(tail), tail[0])
            v /= np.linalg.norm(v)
            p = a @ v
            w = 2 * (p - (v @ p) * v)
            a -= np.outer(v, w) + np.outer(w, v)
        turns.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), turns


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eigenvalues of the tridiagonal matrix below each of ``at``: negative pivots of its shifted factorisation."""
    square = np.concatenate([[0.0], off**2])
    least = np.finfo(float).tiny * max(1.0, square.max())
    pivot = np.ones(len(at))
    below = np.zeros(len(at), np.int64)
    for a, b in zip(diagonal, square, strict=True):
        pivot = a - at - b / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each halved down to neighbouring doubles, or to rounding around zero."""
    d = len(diagonal)
    near = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    wide = 2 * np.finfo(float).eps * np.abs(diagonal).max() + np.finfo(float).tiny
    low = np.full(k, (diagonal - near).min() - wide)
    high = np.full(k, (diagonal + near).max() + wide)
    wanted = d - 1 - np.arange(k)
    least = np.finfo(float).eps ** 2 * max(np.abs(low).max(), np.abs(high).max())
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high) | (high - low < least)).all():
            return middle
        above = sturm_count(diagonal, off, middle) > wanted
        high = np.where(above, middle, high)
        low = np.where(above, low, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
    """Solves ``(T - shift) x = b`` by elimination with row exchanges; pivots below ``least`` are raised to it."""
    d = len(diagonal)
    first, second, third = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * d
    under = off.tolist()
    swaps, factors = [], []
    for k in range(d - 1):
        swap = abs(under[k]) > abs(first[k])
        if swap:
            first[k], under[k] = under[k], first[k]
            second[k], first[k + 1] = first[k + 1], second[k]
            third[k], second[k + 1] = second[k + 1], 0.0
        if abs(first[k]) < least:
            first[k] = least
        f = under[k] / first[k]
        first[k + 1] -= f * second[k]
        second[k + 1] -= f * third[k]
        swaps.append(swap)
        factors.append(f)
    if abs(first[-1]) < least:
        first[-1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for k in range(d - 1):
            if swaps[k]:
                x[k], x[k + 1] = x[k + 1], x[k]
            x[k + 1] -= factors[k] * x[k]
        for k in range(d - 1, -1, -1):
            if k + 1 < d:
                x[k] -= second[k] * x[k + 1]
            if k + 2 < d:
                x[k] -= third[k] * x[k + 2]
            x[k] /= first[k]
        return np.array(x)

    return solve


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as columns, for falling ``values``."""
    d = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    least = np.finfo(float).eps * norm
    random = np.random.default_rng(seed)
    found = np.zeros((d, len(values)))
    start, last = 0, None
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            start = j
        # equal values get shifts of their own, or each solve would lean to the same vector
        shift = value if last is None or last - value > 10 * least or start == j else last - 10 * least
        last = shift
        solve = _solver(diagonal, off, shift, least)
        x = random.standard_normal(d)
        group = found[:, start:j]
        for _ in range(6):
            x -= group @ (group.T @ x)
            x = solve(x / np.linalg.norm(x))
            x /= np.linalg.norm(x)
        for _ in range(2):
            x -= group @ (group.T @ x)
            x /= np.linalg.norm(x)
        found[:, j] = x
    return found


def leading_components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    size = np.abs(a).max(initial=0.0)
    if not size:
        return np.zeros(min(k, len(a))), np.eye(len(a))[:, :k]
    diagonal, off, turns = tridiagonal(a / size)
    values = leading_eigenvalues(diagonal, off, min(k, len(a)))
    vectors = inverse_iteration(diagonal, off, values)
    for v in reversed(turns):
        vectors -= 2 * np.outer(v, v @ vectors)
    return values * size, vectors / np.linalg.norm(vectors, axis=0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _totals(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows of the fit list and their exact sum by entry."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            n += batch.num_rows
            for at in range(0, batch.num_rows, 512):  # sums of so few scaled entries fit in a long
                total = [a + b for a, b in zip(total, _matrix(batch.column("x").slice(at, 512), d).sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int64()), pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))], ["i", "s"])

    added = vectors.select("x").mapInArrow(partial, "i long, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"))
    n, *total = [int(r.s) for r in added.orderBy("i").collect()]
    return n, total


def _total_products(vectors: DataFrame, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``y`` and of ``y y^T`` over the fit list, ``y = (x - mean) turn``: one partial per task, added by entry."""
    d, k = turn.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = (_matrix(batch.column("x").slice(at, ROWS), d) - mean) @ turn
                total[:k] += y.T @ y
                total[k] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k + 1), k)), pa.array(np.tile(np.arange(k), k + 1)), pa.array(total.ravel())], ["i", "j", "v"])

    added = vectors.select("x").mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((k + 1, k))
    cells = added.toArrow()
    out[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("v").to_numpy()
    return out[k], out[:k]


def scaled(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` of rows whose vector is not null and holds no null or non-finite entry."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("embedding").isNotNull() & ~bad)

    def entry(c):
        c = c.cast("double")
        too_large = F.raise_error(F.lit("an entry of a vector is too large to be scaled exactly")).cast("long")
        return F.when(F.abs(c * SCALE) > LARGEST, too_large).otherwise(F.floor(c * SCALE) + SHIFT)

    return sound.select("vec_id", F.transform("embedding", entry).alias("x"))


def _whitened(rows: DataFrame, d: int, k: int) -> DataFrame:
    """The result for rows whose vectors have ``d`` entries."""
    fit = settle(rows.select("x").distinct())
    n, total = _totals(fit, d)
    # the mean as a whole number and a rest: a difference to the first is exact
    whole = [s // n for s in total]
    mean = np.array(whole, np.float64) + np.array([(s - w * n) / n for s, w in zip(total, whole, strict=True)])
    residue, products = _total_products(fit, mean, np.eye(d))
    covariance = products / n - np.outer(residue / n, residue / n)
    covariance = (covariance + covariance.T) / 2
    values, vectors = leading_components(covariance, k)
    found = values > RANK * d * max(values[0], 0.0)
    values, vectors = values[found], vectors[:, found]
    if not len(values):
        return rows.sparkSession.createDataFrame([], FIELDS)
    turn = vectors / np.sqrt(values)
    residue, products = _total_products(fit, mean, turn)
    error = float(np.abs(products / n - np.outer(residue / n, residue / n) - np.eye(len(values))).max())
    explained = values / np.trace(covariance)
    whole, rest = np.array(whole, np.int64), np.array([s - w * n for s, w in zip(total, whole, strict=True)], np.int64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column("x"), d)
                if float(np.abs(x - mean).max(initial=0.0)) ** 2 * d * float(n) ** 2 < 2.0**62:
                    deviation = ((n * (x - whole) - rest) ** 2).sum(axis=1)
                else:  # whole numbers of any size; one that no long holds raises
                    deviation = [sum((n * (int(c) - w) - r) ** 2 for c, w, r in zip(row, whole.tolist(), rest.tolist(), strict=True)) for row in x]
                out = (x - mean) @ turn
                m, c = out.shape
                ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(m), c)))
                columns = [ids, np.tile(np.arange(1, c + 1, dtype=np.int32), m), np.full(m * c, n), np.repeat(np.array(deviation, np.int64), c), out.ravel(), np.tile(explained, m), np.full(m * c, error)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], [f.split()[0] for f in FIELDS.split(", ")])

    return rows.mapInArrow(project, FIELDS)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per sound row and leading component.

    ``vectors`` has ``vec_id, embedding``; other columns are not read. Rows whose vector is null or holds null or
    non-finite entries have no result. The fit list is each distinct scaled vector once, so repeats don't weigh; rows
    that repeat an id, or have none, each get their own result. Vectors of unlike length are whitened apart, each length
    on its own fit list; empty vectors have no components. There are no more components than the covariance has rank: a
    fit list of one vector gives no rows, as does an empty table. Equal eigenvalues share a plane, in which the axes
    are any orthogonal ones. An entry beyond 2^46, or a deviation beyond a long, raises.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors)
    lengths = [r.d for r in rows.select(F.size("x").alias("d")).where("d > 0").distinct().orderBy("d").collect()]
    parts = [_whitened(rows.where(F.size("x") == d), d, components) for d in lengths]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FIELDS)


@query("op11_embedding_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))
