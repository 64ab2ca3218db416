"""Whitening of vectors, with covariances from variances only (polarisation).

Entries are made whole numbers.  Over the distinct vectors, Spark sums the exact
squares of every dimension's values and of every two dimensions' sums, centred
on whole numbers next to the means so that the squares stay small.  With the
sums themselves these give the variances exactly, and

    cov(i, j) = (var(x_i + x_j) - var(x_i) - var(x_j)) / 2

gives every covariance, as a fraction that is rounded once.  The matrix (its
size depends on the dimensions only) goes to ``eigh`` on the driver; rows are
projected where they are read.

Each task adds up its rows and sends one number per dimension and pair; sums
that could leave 64 bits are made with Python's integers.

Cases: null vectors, and vectors with a null or non-finite entry, take no part;
neither do empty ones and those of another dimension than most (ties: the
smaller).  Null and repeated keys are rows like others.  Entries whose whole
number does not fit become +-2**62; a deviation beyond 64 bits is null.
Components without variance (below ``FLAT`` of the largest) can't be
whitened and are left out; a single distinct vector, or an empty table, gives no row.
Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import map_batches
from leafmill.session import store

# Eigenvalues below this part of the largest are rounding.
FLAT = 1e-11
LIMIT = float(1 << 62)
LOW = 40  # bits of the lower half of a sum


def whole_numbers(rows: DataFrame, vector: str, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """The rows whose vector is finite, with ``__x``: floor(scale * entry) + offset for each entry."""
    v = F.col("__v")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    cut = F.transform(
        v, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(LIMIT)), F.lit(-LIMIT))) + F.lit(offset).cast("long")
    )
    return (
        rows.withColumn("__v", F.col(vector).cast("array<double>"))
        .filter(v.isNotNull() & (F.size(v) > 0) & fine)
        .withColumn("__x", cut).drop("__v")
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim)


def _small(u: np.ndarray, terms: int) -> bool:
    """Whether sums of this many squares of twice these numbers fit 64 bits."""
    most = max(int(u.max()), -int(u.min())) if u.size else 0
    return terms * 4 * most * most < 1 << 62


def _less(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x - centre, with Python's integers where 64 bits might not do."""
    if x.size and max(int(x.max()), -int(x.min()), *map(abs, centre)) >= 1 << 61:
        return x.astype(object) - np.array(centre, dtype=object)
    return x - np.array(centre, dtype=np.int64)


def exact_sums(frame: DataFrame, dim: int, function: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """The sums over all rows of whole numbers that ``function`` gives for a batch of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = function(_matrix(batch.column(0), dim)).astype(object)
                total = part if total is None else total + part
        if total is not None:
            high, low = zip(*[divmod(int(v), 1 << LOW) for v in total])
            columns = [
                pa.array(range(len(total)), pa.int32()),
                pa.array([Decimal(v) for v in high], pa.decimal128(38, 0)), pa.array(low, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "high", "low"])

    parts = frame.mapInArrow(run, "place int, high decimal(38,0), low long")
    found = parts.groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    sums = {r["place"]: (int(r["high"]) << LOW) + r["low"] for r in found}
    return [sums[i] for i in range(len(sums))]


def _sums(x: np.ndarray) -> np.ndarray:
    small = _small(x, len(x))
    return np.append((x if small else x.astype(object)).sum(0).astype(object), len(x))


def _squares(centre: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """Of a batch: the squares of each dimension, then those of each sum of dimensions i < j."""

    def squares(x: np.ndarray) -> np.ndarray:
        u = _less(x, centre)
        if not _small(u, len(u)):
            u = u.astype(object)
        out = [(u * u).sum(0)]
        for i in range(u.shape[1] - 1):
            both = u[:, i + 1 :] + u[:, i : i + 1]
            out.append((both * both).sum(0))
        return np.concatenate(out)

    return squares


def covariance(n: int, sums: list[int], squares: list[int]) -> np.ndarray:
    """The covariances (divisor n) of centred values with these sums and sums of squares."""
    dim = len(sums)
    variance = [n * squares[i] - sums[i] ** 2 for i in range(dim)]
    out, at = np.empty((dim, dim)), dim
    for i in range(dim):
        out[i, i] = variance[i] / n**2
        for j in range(i + 1, dim):
            of_sum = n * squares[at] - (sums[i] + sums[j]) ** 2
            out[i, j] = out[j, i] = (of_sum - variance[i] - variance[j]) / (2 * n**2)
            at += 1
    return out


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` eigenvalues, falling, and their unit vectors as columns."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int((values[:most] > max(values[0], 0.0) * FLAT).sum())
    return values[:kept], vectors[:, :kept]


def whitened(
    rows: DataFrame, most: int = 16, key: str = "vec_id", vector: str = "embedding",
    scale: float = 64.0, offset: int = 1_000_000,
) -> DataFrame:
    """Per row and component: key, component, n, deviation, whitened, explained, identity_error.

    n: distinct vectors.  deviation: n * n times the squared distance from their
    mean.  whitened: the row on the component, in standard deviations.
    explained: the component's share of the variance.  identity_error: the
    largest entry by which the covariance of the whitened distinct vectors, as
    measured on them, differs from the identity.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    schema = (
        f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    numbers = whole_numbers(rows.select(key, vector), vector, scale, offset).select(key, "__x")
    size = F.size("__x")
    dims = numbers.groupBy(size.alias("dim")).agg(F.count(F.lit(1)).alias("rows"))
    usual = dims.orderBy(F.desc("rows"), "dim").first()
    if usual is None:
        return spark.createDataFrame([], schema)
    dim = usual["dim"]
    numbers = numbers.filter(size == dim)
    fit = store(numbers.select("__x").distinct(), "whitening-fit")
    *total, n = exact_sums(fit, dim, _sums)
    centre = [round(s / n) for s in total]
    rest = [s - n * c for s, c in zip(total, centre)]
    v = covariance(n, rest, exact_sums(fit, dim, _squares(centre)))
    values, vectors = components(v, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    turn = vectors / np.sqrt(values)

    def apart(x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        u = _less(x, centre)
        if not _small(u, n * n):
            u = u.astype(object)
        return u * n - np.array(rest, dtype=u.dtype)

    def projected(d: np.ndarray) -> np.ndarray:
        return (d.astype(np.float64) / n) @ turn

    error = _identity_error(fit, dim, n, lambda x: projected(apart(x)))
    shares, count = values / v.trace(), len(values)

    def run(batch):
        d = apart(_matrix(batch.column(1), dim))
        if _small(d, dim) or d.dtype == object:
            squares = (d * d).sum(1)
        else:
            squares = (d.astype(object) ** 2).sum(1)
        deviation = pa.array([s if s < 1 << 63 else None for s in squares.tolist()], pa.int64())
        each = np.repeat(np.arange(len(d)), count)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(d))),
                pa.array(np.full(len(each), n)), deviation.take(pa.array(each)), pa.array(projected(d).ravel()),
                pa.array(np.tile(shares, len(d))), pa.array(np.full(len(each), error)),
            ],
            names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )

    return map_batches(numbers, run, schema)


def _identity_error(fit: DataFrame, dim: int, n: int, project: Callable[[np.ndarray], np.ndarray]) -> float:
    """How far the covariance of the whitened rows is from the identity."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                z = project(_matrix(batch.column(0), dim))
                part = np.concatenate([z.sum(0), (z.T @ z).ravel()])
                total = part if total is None else total + part
        if total is not None:
            columns = [pa.array(range(len(total)), pa.int32()), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "part"])

    found = fit.mapInArrow(run, "place int, part double").groupBy("place").agg(F.sum("part").alias("sum")).collect()
    sums = np.array([r["sum"] for r in sorted(found, key=lambda r: r["place"])])
    count = int((np.sqrt(1 + 4 * len(sums)) - 1) / 2 + 0.5)
    mean = sums[:count] / n
    cov = sums[count:].reshape(count, count) / n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(count)).max())
