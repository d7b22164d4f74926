"""Embedding whitening: covariances by polarisation, exact in whole numbers.

A vector's entries become longs, x = floor(scale * c) + offset. The fit list holds each distinct x-vector once: n vectors with sums S. Cross-covariances come
from variances alone, cov(i, j) = (var(i + j) - var(i) - var(j)) / 2, so what is aggregated is one sum of squares for each
dimension and for the sum of each pair of dimensions. Squares are of centred values: y is x less the mean rounded to a whole number, and what is left of the mean
comes back exactly, n**2 * sum(y**2) - n * sum(y)**2 being n times the sum of (n*x - S)**2 / n. All sums are whole numbers without rounding; V is divided once.

Plan: one shuffle of distinct x-vectors (copies meet in each task first), written; then three passes without a shuffle of vectors: sums, sums of squares, and
the whitened covariance. A task returns d * (d + 1) / 2 numbers at most, which Spark adds up as decimals. The driver holds d by d numbers
and takes ``eigh`` of them: its work follows the number of dimensions, never that of rows.

Edge cases: rows whose vector is null, or holds a null or non-finite entry, are left out, as are vectors without entries and those of another length than the
commonest (ties: the longest); entries beyond 2**40 in size saturate there. Copies of a vector count once in the fit and each get a result. Where an eigenvalue is zero
to double precision there is nothing to divide by: whitened is null and that component is left out of identity_error. An empty table gives no rows. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrainframe.llm.common import materialise

SCALE, OFFSET, COMPONENTS, MOST = 64, 1_000_000, 16, 1 << 40
#: Vectors at a time, and the largest sum of squares that is left in 64 bits.
ROWS, SAFE = 4096, 1 << 62


def whole(vector: Column) -> Column:
    """The x-vector of a vector of finite entries."""
    at_most = lambda c: F.greatest(F.least(c.cast("double"), F.lit(float(MOST))), F.lit(-float(MOST)))
    return F.transform(vector, lambda c: F.floor(at_most(c) * SCALE).cast("long") + OFFSET)


def usable(rows: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite, with its x-vector as ``_x``."""
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(vector.isNotNull() & (F.size(vector) > 0) & finite).withColumn("_x", whole(vector))


def blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """x-vectors as arrays of at most ``ROWS`` rows."""
    for batch in batches:
        column = batch.column(0)
        for at in range(0, len(column), ROWS):
            yield column.slice(at, ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Sums:
    """Exact sums: 64-bit numbers while they are sure to fit, whole numbers of any size beyond."""

    def __init__(self, width: int):
        self.now, self.all, self.used = np.zeros(width, np.int64), [0] * width, 0

    def add(self, part: np.ndarray, bound: int) -> None:
        if self.used + bound > SAFE:
            self.flush()
        self.now += part
        self.used += bound

    def flush(self) -> None:
        self.all = [a + int(b) for a, b in zip(self.all, self.now, strict=True)]
        self.now[:], self.used = 0, 0

    def rows(self) -> pa.RecordBatch:
        self.flush()
        kept = [(i, str(v)) for i, v in enumerate(self.all) if v]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.int32()), pa.array([v for _, v in kept], pa.string())], names=["place", "value"])


def summed(fit: DataFrame, kernel, width: int) -> list[int]:
    """Whole numbers that ``kernel`` gives a task by place, added over all tasks."""
    parts = fit.select("_x").mapInArrow(kernel, "place int, value string").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).toArrow()
    out = [0] * width
    for place, value in zip(parts.column("place").to_pylist(), parts.column("value").to_pylist(), strict=True):
        out[place] = int(value)
    return out


def sums(d: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sums(d + 1)
        for x in blocks(batches, d):
            out.add(np.append(x.sum(0), len(x)), len(x) * int(np.abs(x).max()))
        yield out.rows()

    return kernel


def pairs(d: int) -> list[tuple[int, int]]:
    """Places of the sums of squares: i + j for each pair of dimensions, 2 * i where both are one."""
    return [(i, j) for i in range(d) for j in range(i, d)]


def squares(d: int, means: list[int]):
    """Sums over rows of (y_i + y_j) ** 2, and of y_i ** 2, y being x less the rounded mean."""
    shift = np.array(means, np.int64)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sums(d * (d + 1) // 2)
        for x in blocks(batches, d):
            y = x - shift
            most = 2 * int(np.abs(y).max(initial=0))
            if most * most * len(y) < SAFE:
                out.add(np.concatenate([np.append((y[:, i] ** 2).sum(), ((y[:, i : i + 1] + y[:, i + 1 :]) ** 2).sum(0)) for i in range(d)]), most * most * len(y))
            else:  # entries far apart: whole numbers of any size
                y = y.astype(object)
                add = [v for i in range(d) for v in [(y[:, i] ** 2).sum(), *((y[:, i : i + 1] + y[:, i + 1 :]) ** 2).sum(0)]]
                out.all = [a + int(b) for a, b in zip(out.all, add, strict=True)]
        yield out.rows()

    return kernel


class Basis:
    """What a fit leaves: n, S, the rounded means, V's leading eigenvectors (as columns) and eigenvalues, explained shares."""

    def __init__(self, n: int, sums: list[int], means: list[int], squared: list[int], components: int):
        d = len(sums)
        self.n, self.sums, self.means = n, sums, means
        self.rest = [s - n * m for s, m in zip(sums, means, strict=True)]
        var = {}
        for (i, j), v in zip(pairs(d), squared, strict=True):
            gone = self.rest[i] + (self.rest[j] if i != j else 0)
            var[i, j] = n * v - gone * gone  # n ** 2 times the variance of a dimension, or of the sum of two
        self.covariance = np.zeros((d, d))
        for i, j in pairs(d):
            twice = 2 * var[i, i] if i == j else var[i, j] - var[i, i] - var[j, j]
            self.covariance[i, j] = self.covariance[j, i] = float(Fraction(twice, 2 * n * n))
        values, vectors = np.linalg.eigh(self.covariance)
        k = min(components, d)
        self.values, self.vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        lead = np.abs(self.vectors).argmax(0)
        self.vectors = self.vectors * np.where(self.vectors[lead, np.arange(k)] < 0, -1.0, 1.0)
        trace = float(sum(Fraction(var[i, i], n * n) for i in range(d)))
        self.live = self.values > d * np.finfo(float).eps * max(float(values[-1]), 0.0)
        self.explained = [float(v) / trace if trace else None for v in self.values]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; columns without a spread are not a number."""
        centred = (x - np.array(self.means)).astype(float) - np.array([float(Fraction(r, self.n)) for r in self.rest])
        return centred @ np.where(self.live, self.vectors / np.sqrt(np.where(self.live, self.values, 1.0)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2, exact."""
        y = x - np.array(self.means)
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.rest), default=0)
        if most * most * x.shape[1] < SAFE:
            return ((self.n * y - np.array(self.rest)) ** 2).sum(1).tolist()
        found = ((y.astype(object) * self.n - np.array(self.rest, object)) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in found]


def identity_error(fit: DataFrame, basis: Basis, d: int) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    k = len(basis.values)
    shared = fit.sparkSession.sparkContext.broadcast(basis)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for x in blocks(batches, d):
            w = shared.value.whitened(x)
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel())], names=["place", "value"])

    parts = fit.select("_x").mapInArrow(kernel, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    found = np.full(k * k, np.nan)
    found[parts.column("place").to_numpy()] = parts.column("value").to_numpy()
    left = np.abs(found.reshape(k, k) / basis.n - np.eye(k))[np.ix_(basis.live, basis.live)]
    return float(left.max()) if left.size else None


def whiten(rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The usable rows with ``whitening``: n, deviation, whitened and explained (arrays by component), identity_error."""
    keep = [c for c in rows.columns if c != "whitening"]
    told = usable(rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]), f"c{keep.index(vector_col)}")
    kind = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    named = lambda df, w: df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], w.alias("whitening"))
    lengths = told.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return named(told, F.lit(None).cast(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>"))
    d = lengths["d"]
    told = told.where(F.size("_x") == d)
    fit = materialise(told.select("_x").distinct(), "fit-list")
    *totals, n = summed(fit, sums(d), d + 1)
    means = [(2 * s + n) // (2 * n) for s in totals]
    basis = Basis(n, totals, means, summed(fit, squares(d, means), d * (d + 1) // 2), components)
    error = identity_error(fit, basis, d)
    shared = rows.sparkSession.sparkContext.broadcast(basis)

    def results(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            own = shared.value
            x = batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            w = own.whitened(x)
            k = w.shape[1]
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(x) + 1) * k, k, dtype=np.int32)), pa.array(w.ravel(), mask=np.isnan(w.ravel())))
            explained = pa.array([own.explained] * len(x), pa.list_(pa.float64()))
            yield pa.StructArray.from_arrays(
                [pa.array(np.full(len(x), own.n)), pa.array(own.deviations(x), pa.int64()), whitened, explained, pa.array([error] * len(x), pa.float64())],
                names=["n", "deviation", "whitened", "explained", "identity_error"],
            )

    return named(told, F.arrow_udf(results, kind)(F.col("_x")))
