"""Whitened vectors against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafmill.llm import whitening

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def expected(vectors, most):
    """Eigenvalues, and per vector its deviation and whitened entries up to sign."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * a - s for a, s in zip(v, sums)] for v in fit], dtype=np.float64) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:most], turn[:, ::-1][:, :most]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    rows = np.array([[n * a - s for a, s in zip(v, sums)] for v in x], dtype=np.float64) / n
    return n, values / (centred**2).sum() * n, deviations, rows @ turn / np.sqrt(values)


def compare(found, keys, vectors, most):
    n, shares, deviations, white = expected(vectors, most)
    by_key = {}
    for r in found:
        by_key.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(found) == len(keys) * white.shape[1] and sorted(by_key) == sorted(keys)
    signs = None
    for key, row, deviation in zip(keys, white, deviations):
        mine = [by_key[key][c + 1] for c in range(white.shape[1])]
        assert {r["n"] for r in mine} == {n} and {r["deviation"] for r in mine} == {deviation}
        assert max(r["identity_error"] for r in mine) <= 1e-4
        assert np.allclose([r["explained"] for r in mine], shares, rtol=1e-9)
        got = np.array([r["whitened"] for r in mine])
        signs = np.sign(got * row) if signs is None else signs
        assert np.allclose(got, row * signs, atol=1e-6)


def test_given_vectors(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    frame = entry.queries()["op12_whitening"](spark, FOLDER)
    assert frame.dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
        ("explained", "double"), ("identity_error", "double"),
    ]
    compare(frame.collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows], 16)


def test_odd_vectors(spark):
    """Nulls, non-finite entries, other dimensions, copies, null keys and clashing columns."""
    rng = np.random.default_rng(3)
    good = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) * [9, 5, 3, 2, 1]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(good)]
    rows += [(100 + i, rows[7][1]) for i in range(40)]
    odd = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [math.nan] * 5), (203, [math.inf] + [0.0] * 4)]
    odd += [(204, []), (205, [1.0] * 4)]
    frame = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    for clash in ("component", "n", "place", "__v", "x", "dim", "rows"):
        frame = frame.withColumn(clash, F.lit("clash"))
    compare(whitening.whitened(frame, 16).collect(), [r[0] for r in rows], [r[1] for r in rows], 16)
    twice = spark.createDataFrame([(None, v) for _, v in rows] + rows[:3] * 2, SCHEMA)
    found = whitening.whitened(twice, 2).collect()
    assert len(found) == 2 * (len(rows) + 6) and sum(r["vec_id"] is None for r in found) == 2 * len(rows)


@pytest.mark.parametrize("size", [1e-3, 1e6, 1e12, 1e15])
def test_sums_are_exact_at_any_size(spark, size):
    rng = np.random.default_rng(5)
    vectors = [[float(c) for c in v] for v in rng.normal(size=(50, 4)) * [size, size / 2, size / 3, size / 4]]
    frame = spark.createDataFrame(list(enumerate(vectors)), SCHEMA).repartition(3)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    found = whitening.whitened(frame, 4).collect()
    if n == 1:
        assert not found
    for r in found:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums))
        assert r["deviation"] == (deviation if deviation < 1 << 63 else None)
        assert r["identity_error"] <= 1e-4


def test_polarisation_is_exact():
    rng = np.random.default_rng(8)
    x = rng.integers(-(1 << 40), 1 << 40, size=(30, 6)).astype(np.int64)
    centre = [int(c) for c in x.mean(0)]
    squares = [int(v) for v in whitening._squares(centre)(x)]
    rest = [sum(int(v) for v in x[:, i]) - 30 * c for i, c in enumerate(centre)]
    v = whitening.covariance(30, rest, squares)
    for i in range(6):
        for j in range(6):
            a, b = [[30 * int(v) - sum(map(int, x[:, k])) for v in x[:, k]] for k in (i, j)]
            assert v[i, j] == sum(p * q for p, q in zip(a, b)) / 30**3


def test_too_little_to_whiten(spark):
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)
    assert whitening.whitened(one).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], SCHEMA)
    assert {r["component"] for r in whitening.whitened(line).collect()} == {1}
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 5.0]), (3, [1.0, 1.0])], SCHEMA)
    assert {r["vec_id"] for r in whitening.whitened(huge).collect() if r["deviation"] is None} == {1, 2}
