"""Whitening of embeddings by singular value decomposition.

Vectors become whole numbers, so sums and deviations over all rows are exact and do not depend
on the order of tasks. The model is fitted on the distinct vectors: their count n and sums S in
one pass, then MLlib's computeSVD on the centred distributed rows (n*x - S) / n. Its singular
values s give the eigenvalues s*s/n of the covariance with divisor n; the total variance is the
sum of the exact deviations and not of the eigenvalues, so components that are not asked for
count too. The driver holds S, and dims x dims numbers inside computeSVD, whatever n is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm import common

#: Fixed-point steps of an entry, and what is added to a whole number.
SCALE, SHIFT = 64, 1_000_000
#: Components with an eigenvalue below this part of the first are taken as none: singular values come from a Gram matrix in doubles.
LEAST = 1e-12
_INT64 = float(1 << 62)


@dataclass(frozen=True)
class Whitening:
    """A fitted model: count and sums of the fit list, components (dims x k), eigenvalues, total variance, largest error of the whitened covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    total: float
    identity_error: float


def fixed_point(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    """Written table (vec_id, x) of vectors: floor(64 * entry) + 1,000,000 as longs.

    Rows go whose vector is null, empty, or holds entries that are null, not finite or too large for
    a long. One space has one length: vectors of another length than most rows have (of equally
    frequent lengths the longest) go too.
    """
    whole = F.col(col).isNotNull() & (F.size(col) > 0) & F.forall(col, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < (1 << 53)))
    x = F.transform(F.col(col), lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    rows = common.materialize(vectors.where(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long"), x.alias("x")))
    most = rows.groupBy(F.size("x").alias("dims")).count().agg(F.max(F.struct("count", "dims")).alias("m")).first()["m"]
    return rows.where(F.size("x") == (most["dims"] if most else 0))


def _entries(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _totals(parts: DataFrame) -> list:
    """Sums by position of the arrays `part`, one a task: as many rows reach the driver as an array has entries."""
    return [r[0] for r in parts.select(F.posexplode("part").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").select("v").collect()]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact: as int64, or as Python's whole numbers where those do not hold it."""
    if not len(x) or (float(np.abs(x).max()) + max(map(abs, sums)) / n + 1) * n < _INT64:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviations(centred: np.ndarray) -> list[int] | np.ndarray:
    if centred.dtype != object and float(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < _INT64:
        return (centred * centred).sum(axis=1)
    return [sum(v * v for v in row) for row in centred.tolist()]


def fit(x: DataFrame, components: int) -> Whitening | None:
    """Fit on the distinct vectors of the column x; None without rows. Fewer components come back where the variance has fewer dimensions."""
    rows = common.materialize(x.select("x").distinct())
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            e = _entries(batch, "x")
            if len(e):  # the count comes last; sums of a batch may pass int64, so halves are summed apart
                part = [int(h) * (1 << 32) + int(low) for h, low in zip((e >> 32).sum(axis=0), (e & 0xFFFFFFFF).sum(axis=0))] + [len(e)]
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[Decimal(v) for v in total]], pa.list_(pa.decimal128(38, 0)))], names=["part"])

    *s, n = map(int, _totals(rows.mapInArrow(sums, "part array<decimal(38,0)>")))

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = (_centred(_entries(batch, "x"), n, s) / n).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(0, c.size + 1, c.shape[1], dtype=np.int32), c.ravel())], names=["c"])

    centred = rows.mapInArrow(centre, "c array<double>").select(array_to_vector("c").alias("v"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, len(s))
    total = _total_variance(rows, n, s)
    if total == 0:
        return Whitening(n, s, np.zeros((len(s), 0)), np.zeros(0), 0.0, 0.0)
    # all components, as MLlib then decomposes by LAPACK to double precision and not by iteration up to a tolerance
    svd = matrix.computeSVD(len(s), computeU=False, rCond=LEAST**0.5)
    e = np.asarray(svd.s.toArray()) ** 2 / n
    k = min(components, len(e))
    w = np.asarray(svd.V.toArray())[:, :k]
    model = Whitening(n, s, w, e[:k], total, 0.0)
    return Whitening(n, s, w, e[:k], total, _identity_error(rows, model))


def _total_variance(rows: DataFrame, n: int, sums: list[int]) -> float:
    def deviations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(map(int, _deviations(_centred(_entries(batch, "x"), n, sums)))) for batch in batches if batch.num_rows)
        # in two digits to base 10**30, as the sum over all rows may have more than 38 decimals
        yield pa.RecordBatch.from_arrays([pa.array([[Decimal(total // 10**30), Decimal(total % 10**30)]], pa.list_(pa.decimal128(38, 0)))], names=["part"])

    high, low = map(int, _totals(rows.mapInArrow(deviations, "part array<decimal(38,0)>")))
    return float((high * 10**30 + low) / n**3)


def _whitened(x: np.ndarray, m: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Exact centred numerators and whitened rows."""
    centred = _centred(x, m.n, m.sums)
    return centred, (centred / m.n).astype(np.float64) @ m.components / np.sqrt(m.eigenvalues)


def _identity_error(rows: DataFrame, m: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = m.components.shape[1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k + k)
        for batch in batches:
            if batch.num_rows:
                y = _whitened(_entries(batch, "x"), m)[1]
                total += np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["part"])

    total = np.array(_totals(rows.mapInArrow(products, "part array<double>"))) / m.n
    mean = total[k * k :]  # zero but for rounding, as the rows are centred before they are projected
    return float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row per vector and component, components numbered from 1 by falling variance.

    deviation is the exact sum over dimensions of (n*x - S)**2, as decimal(38,0); whitened is x
    less the mean, projected on the unit component, over the root of its eigenvalue; explained is
    the eigenvalue's part of the total variance. Vectors that `fixed_point` leaves out give no
    rows. Equal vectors are fitted once and each of their rows is returned, rows with a null or
    repeated vec_id too. Directions without variance are no components, so a table of one
    distinct vector, like an empty one, gives no rows. Other columns are ignored.
    """
    if components < 1:
        raise ValueError("at least one component")
    x = fixed_point(vectors)
    m = fit(x, components)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if m is None:
        return x.sparkSession.createDataFrame([], schema)
    k = len(m.eigenvalues)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            centred, y = _whitened(_entries(batch, "x"), m)
            ids = np.repeat(np.arange(batch.num_rows), k)
            d = pa.array([Decimal(int(v)) for v in _deviations(centred)], pa.decimal128(38, 0))
            size = batch.num_rows * k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(ids)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(size, m.n)), d.take(pa.array(ids)),
                    pa.array(y.ravel()), pa.array(np.tile(m.eigenvalues / m.total, batch.num_rows)), pa.array(np.full(size, m.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(project, schema)
