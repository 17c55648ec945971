"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi directly on the triangular factor.

Entries become the whole numbers floor(64 c) + 1000000. The distinct vectors are the fit list; their sums are exact, and
every task adds up the scatter of its own vectors after centring, one square matrix of the dimension. Those partial
matrices are summed by row, in two steps. Only the sum reaches the driver, which factors it: the Cholesky factor's columns
are rotated against each other until they are orthogonal; their squared lengths are the eigenvalues, their directions the
components. The covariance of the whitened fit list is measured in a pass of its own.

The driver and a task hold matrices of dimension x dimension, so the dimension is bounded by `MAX_DIMENSION` (an error
beyond it); rows are never gathered. Vectors meet for the distinct list by shuffle, after each task has dropped its own copies.

Rows whose vector is null, empty or holds null or non-finite entries are dropped, likewise those with an entry that fits no
long and those of another length than most (ties: the shorter). Repeated rows and equal or null ids keep their rows.
Further columns are ignored. Directions without variance are no components; an empty table, or one with a single distinct
vector, gives no rows. A deviation that fits no long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_batches, slices, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
MAX_DIMENSION = 4096
SALTS = 64
_LARGEST = float(1 << 62)


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part, all of one length."""
    fits = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < _LARGEST / SCALE)) & (F.size("v") > 0)
    # a null vector or NaN fails the test
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(fits & F.forall("v", lambda c: ~F.isnan(c)))
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("x") == F.lit(most["d"] if most else -1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums, exactly: as 64-bit integers where they surely fit, else as Python integers."""
    whole, rest = np.array([s // n for s in sums], object), np.array([s % n for s in sums], object)
    reach = max((abs(int(x.min()) - int(whole.max())), abs(int(x.max()) - int(whole.min())))) + 1 if x.size else 0
    if reach * n < 1 << 62:
        return (x - whole.astype(np.int64)) * np.int64(n) - rest.astype(np.int64)
    return (x.astype(object) - whole) * n - rest


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums = 0, None
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column("x"))
            low, high = x & 0xFFFFFFFF, x >> 32
            own = low.sum(axis=0).astype(object) + high.sum(axis=0).astype(object) * (1 << 32)
            n, sums = n + len(x), own if sums is None else sums + own
    if n:
        yield from arrow_batches({"dim": np.arange(len(sums), dtype=np.int32), "n": np.full(len(sums), n), "s": [str(s) for s in sums]},
                                 pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("s", pa.string())]))


def _products(of: Callable[[np.ndarray], np.ndarray]):
    """Per task the sum of y'y over its vectors, as rows (i, values), y being `of` the vectors with a last column of ones."""
    schema = pa.schema([("i", pa.int32()), ("part", pa.int64()), ("row", pa.list_(pa.float64()))])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = 0.0, None
        for b in slices(batches, 4096):
            x = _matrix(b.column("x"))
            if len(x):
                y = of(x)
                y = np.hstack([y, np.ones((len(y), 1))])
                total = total + y.T @ y
                part = int(x[0].sum()) % SALTS if part is None else part
        if part is not None:
            yield from arrow_batches({"i": np.arange(len(total), dtype=np.int32), "part": np.full(len(total), part), "row": list(total)}, schema)

    return multiply


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": rows["i"].iloc[:1], "part": rows["part"].iloc[:1], "row": [np.sum(np.stack(rows["row"].to_numpy()), axis=0)]})


def second_moments(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean products and means of `of` the fit list."""
    schema = "i int, part bigint, row array<double>"
    rows = fit.mapInArrow(_products(of), schema)
    rows = rows.groupBy("i", "part").applyInPandas(_added, schema).groupBy("i").applyInPandas(_added, schema)
    whole = np.array([r["row"] for r in rows.select("i", "row").orderBy("i").toLocalIterator()]) / n
    return whole[:-1, :-1], whole[-1, :-1]


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L (rows in the order of `v`, as many columns as the rank) with L L' = v; a column is pivoted to the largest rest."""
    rest, order, columns = v.diagonal().copy(), np.arange(len(v)), []
    floor = len(v) * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    for k in range(len(v)):
        p = k + int(rest[order[k:]].argmax())
        order[[k, p]] = order[[p, k]]
        pivot = order[k]
        if rest[pivot] <= floor:
            break
        column = np.zeros(len(v))
        below = order[k + 1:]
        before = np.array(columns).reshape(k, len(v))
        column[pivot] = np.sqrt(rest[pivot])
        column[below] = (v[below, pivot] - before[:, below].T @ before[:, pivot]) / column[pivot]
        rest[below] -= column[below] ** 2
        columns.append(column)
    return np.array(columns).reshape(len(columns), len(v)).T


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of factor factor', by rotating the columns of the factor in
    rounds of disjoint pairs until all are orthogonal."""
    a = factor.T.copy()
    size = len(a) + len(a) % 2
    ring = np.arange(size)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(size - 1):
            p, q = ring[:size // 2], ring[size // 2:][::-1]
            real = np.maximum(p, q) < len(a)
            p, q = p[real], q[real]
            ring = np.concatenate((ring[:1], ring[-1:], ring[1:-1]))
            x, y = a[p], a[q]
            xx, yy, xy = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
            angle = np.abs(xy) / np.maximum(np.sqrt(xx * yy), 1e-300)
            worst = max(worst, angle.max(initial=0.0))
            turn = angle > 1e-16
            z = (yy - xx) / np.where(turn, 2 * xy, 1.0)
            t = np.where(turn, np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.hypot(1.0, z)), 0.0)
            c = 1 / np.hypot(1.0, t)
            a[p], a[q] = c[:, None] * x - (c * t)[:, None] * y, (c * t)[:, None] * x + c[:, None] * y
        if worst < 4e-16:
            break
    values = (a * a).sum(axis=1)
    order = np.argsort(-values, kind="stable")
    return values[order], (a[order] / np.sqrt(values[order])[:, None]).T


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row of `vectors` (vec_id, embedding)
    that takes part, for the first components."""
    spark = vectors.sparkSession
    rows = quantised(vectors)
    fit = written(rows.select("x").distinct(), "fit")
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    totals = fit.mapInArrow(_totals, "dim int, n bigint, s string").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").limit(MAX_DIMENSION + 1).collect()
    if len(totals) > MAX_DIMENSION:
        raise ValueError(f"vectors of more than {MAX_DIMENSION} entries")
    n, sums = (int(totals[0]["n"]), [int(r["s"]) for r in totals]) if totals else (0, [])

    def deviations(x: np.ndarray) -> np.ndarray:
        return (centred(x, n, sums) / n).astype(np.float64)

    v = second_moments(fit, deviations, n)[0] if n > 1 else np.zeros((0, 0))
    values, directions = jacobi(pivoted_cholesky(v))
    if not len(values):
        return spark.createDataFrame([], schema)
    explained = (values / v.trace())[:components]
    onto = directions[:, :components] / np.sqrt(values[:components])
    products, means = second_moments(fit, lambda x: deviations(x) @ onto, n)
    error = float(np.abs(products - np.outer(means, means) - np.eye(len(products))).max())
    shared = spark.sparkContext.broadcast((n, sums, onto, explained))
    return rows.mapInArrow(_projector(shared, error), schema)


def _projector(shared, error: float):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, onto, explained = shared.value
        k = len(explained)
        for b in slices(batches, 4096):
            if b.num_rows:
                z = centred(_matrix(b.column("x")), n, sums)
                if z.dtype == object or np.abs(z).max() > (_LARGEST / z.shape[1]) ** 0.5:
                    exact = (z.astype(object) ** 2).sum(axis=1)
                    deviation = pa.array([int(e) if e < 1 << 63 else None for e in exact], pa.int64()).take(pa.array(np.repeat(np.arange(len(z)), k)))
                else:
                    deviation = np.repeat((z * z).sum(axis=1), k)
                w = (z / n).astype(np.float64) @ onto
                ids = b.column("vec_id").take(pa.array(np.repeat(np.arange(len(z)), k)))
                out = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), len(z)), np.full(w.size, n, np.int64), deviation, w.ravel(),
                       np.tile(explained, len(z)), np.full(w.size, error)]
                names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=names)

    return project
