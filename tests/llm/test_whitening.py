"""Whitening against numpy's double precision, and the refinement against eigenvalues known beforehand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def brute(rows, components=4):
    """vec_id -> rows of the contract, from plain numpy."""
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in fine), default=0)
    whole = [(i, [math.floor(256 * c) for c in v] + [0] * (width - len(v))) for i, v in fine]
    if not width:
        return []
    x = np.array(sorted(set(tuple(v) for _, v in whole)), float)
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    centred = x - np.array(sums) / n
    variance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(variance)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, v in whole:
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        for k in range(min(components, width)):
            lost = values[k] <= width * np.finfo(float).eps * values[0]
            along = None if lost else abs((np.array(v) - np.array(sums) / n) @ vectors[:, k] / np.sqrt(values[k]))
            out.append((i, k + 1, n, deviation, along, 0.0 if lost else values[k] / np.trace(variance)))
    return out


def compared(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in (r[0], r[1], r[3], None if r[4] is None else round(abs(r[4]), 6)))
    got = sorted(got, key=key)
    want = sorted(want, key=key)
    assert [(*r[:4], r[4] is None) for r in got] == [(*r[:4], r[4] is None) for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[4] is None or abs(abs(a[4]) - b[4]) < 1e-9 * max(1, b[4])
        assert abs(a[5] - b[5]) <= 1e-9 * max(b[5], 1e-300) + 1e-15


@pytest.mark.parametrize("n,dims", [(0, 4), (1, 3), (2, 2), (60, 3), (300, 17)])
def test_against_numpy(spark, n, dims):
    draw = np.random.default_rng(n)
    rows = [(i, v.round(2).tolist()) for i, v in enumerate(draw.normal(0, 0.3, (n, dims)) * np.arange(1, dims + 1))]
    if n > 10:
        rows += [(100 + i, rows[7][1]) for i in range(200)]  # a hot vector
        rows += [(None, rows[0][1]), (3, rows[3][1]), (1, None), (2, [None] * dims), (4, [float("nan")] * dims), (5, [float("-inf")] * dims)]
        rows += [(900, rows[1][1][:-1] + [0.0]), (901, rows[1][1][:-1]), (902, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, component string").repartition(5)
    found = whitening.whitened(table)
    compared([tuple(r) for r in found.collect()], brute(rows))


def test_signs_and_order_are_one_for_all_rows(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = queries.op13_refined_whitening(spark, SF)
    rows = np.array([(r["vec_id"], r["component"], r["whitened"]) for r in got.collect()])
    assert len(rows) == 4 * table.count()
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    seen = rows[:, 2].reshape(-1, 4)
    # Every vector is there once, so what all rows give is white and has no mean.
    assert np.abs(np.cov(seen.T, bias=True) - np.eye(4)).max() < 1e-9 and np.abs(seen.mean(axis=0)).max() < 1e-9
    assert got.agg(F.max("identity_error")).first()[0] < 1e-9
    assert got.select("explained").distinct().count() == 4


def test_values_beyond_longs_and_their_sums(spark):
    rows = [(1, [1e300, 0.0]), (2, [2.0**40, 1.0]), (3, [-(2.0**40), 0.5]), (4, [2.0**52, -1.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"] for r in got} == {2, 3, 4} and all(r["deviation"] is None for r in got)
    assert all(math.isfinite(r["whitened"]) for r in got if r["component"] == 1)


def spectrum(values, seed=0):
    """A symmetric matrix with these eigenvalues, and its eigenvectors, made in the wider precision."""
    d, draw = len(values), np.random.default_rng(seed)
    q = np.linalg.qr(draw.normal(size=(d, d)))[0].astype(whitening.WIDE)
    for _ in range(3):
        q = q @ (3 * np.eye(d) - q.T @ q) / 2
    return q, (q * np.array(values, whitening.WIDE)) @ q.T


@pytest.mark.parametrize("gaps", [1e-2, 1e-5, 1e-7, 1e-9, 1e-10])
def test_clusters_that_float32_does_not_see(gaps):
    values = np.array([3.0, 2 + 2 * gaps, 2 + gaps, 2.0, 1 + gaps, 1.0, 0.5, 1e-3])
    q, matrix = spectrum(values)
    found, vectors = whitening.refined(matrix.astype(np.float64))
    assert np.abs(found - values).max() < 1e-14
    # The matrix itself is rounded to double, which moves vectors by its rounding over the gap.
    assert (1 - np.abs((q * vectors).sum(axis=0))).max() < max(1e-14, (1e-15 / gaps) ** 2 * 100)
    residue = matrix.astype(np.float64) @ vectors - vectors * found
    assert np.abs(residue).max() < 1e-14 and np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-14


def test_equal_eigenvalues_and_none():
    found, vectors = whitening.refined(np.diag([2.0, 2.0, 2.0, 1.0, 0.0, 0.0]))
    assert found.tolist() == pytest.approx([2, 2, 2, 1, 0, 0], abs=1e-15)
    assert np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-15
    assert whitening.refined(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
    assert whitening.refined(np.zeros((0, 0)))[1].shape == (0, 0)
