"""Whitening against numpy's eigenvectors of the plain covariance, and exact integers."""

import math
from collections import Counter

import numpy as np
import pytest

from factorloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, component string, n int, _x int"


def grid(v):
    return [math.floor(256 * float(np.float32(c))) + 0 for c in v]


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", "c", 1, 2) for i, v in vectors], SCHEMA).repartition(3)


def right(v, dims):
    return v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)


def check(spark, vectors, dims, components=4):
    df = frame(spark, vectors)
    model = whitening.fit_whitening(df, components=components)
    kept = [(i, grid(v)) for i, v in vectors if right(v, dims)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, sums = len(fit), fit.sum(axis=0)
    assert model.n == n and model.sums.tolist() == sums.tolist()
    centred = (n * fit - sums).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1].T
    rank = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(model.eigenvalues) == rank
    got = whitening.whiten(df, model).collect()
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, k + 1) for i, _ in kept for k in range(rank))
    assert model.eigenvalues == pytest.approx(values[:rank], rel=1e-9)
    deviation = Counter((i, sum(int(d) ** 2 for d in n * np.array(x, object) - sums)) for i, x in kept)
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == deviation
    assert all(r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and r.n == n and r.identity_error < 1e-9 for r in got)
    for k in range(rank):
        want = {i: float(((n * np.array(x, object) - sums).astype(float) / n) @ axes[k] / math.sqrt(values[k])) for i, x in kept}
        mine = {r.vec_id: r.whitened for r in got if r.component == k + 1}
        sign = 1 if sum(want[i] * mine[i] for i in want) > 0 else -1
        assert all(mine[i] == pytest.approx(sign * want[i], abs=1e-7) for i in want)
    return model


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    base = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))).astype(np.float32).tolist()
    vectors = list(enumerate(base + [base[3]] * 150))  # one vector is a third of the rows
    bad = [None, [], [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, base[0][:5], base[0] + [1.0], base[1][:-1] + [None], [float("-inf")] * 12]
    vectors += [(1000 + i, v) for i, v in enumerate(bad)] + [(None, base[4]), (7, base[7]), (7, base[7]), (2000, [-0.0] * 12), (2001, [0.001] * 12)]
    model = check(spark, vectors, 12)
    assert model.passes <= 5


def test_directions_that_hardly_or_never_vary(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6)) * [1000, 100, 10, 1, 0.1, 0]
    x = np.column_stack([x, x[:, 0], x[:, 1] - x[:, 2], np.full(400, 3.0)])  # dependent and constant ones
    exact = np.floor(x * 256) / 256
    check(spark, list(enumerate(exact.tolist())), 9)
    low = np.column_stack([exact[:, 0], 2 * exact[:, 0], np.zeros(400)])  # rank one
    model = check(spark, list(enumerate(low.tolist())), 3)
    assert len(model.eigenvalues) == 1


def test_scales_far_apart(spark):
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(300, 4)) * [4e6, 4e3, 40, 0.5] * 256) / 256
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    df = frame(spark, rows)
    model = whitening.fit_whitening(df)
    assert len(model.eigenvalues) == 4 and model.identity_error < 1e-6
    fit = np.array(sorted({tuple(grid(v)) for _, v in rows}), float)
    centred = fit - fit.mean(axis=0)
    want = np.linalg.svd(centred, compute_uv=False) ** 2 / len(fit)
    assert model.eigenvalues == pytest.approx(want, rel=1e-7)


def test_few_vectors_and_none(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        df = frame(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
        assert whitening.whiten(df, whitening.fit_whitening(df)).count() == 0
    check(spark, [(1, [1.0, 2.0, 5.0]), (2, [2.0, 2.0, 1.0])], 3)


def test_large_entries(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1e20, 2.0]), (4, [5.0, 3.0])]
    df = frame(spark, rows)
    got = whitening.whiten(df, whitening.fit_whitening(df)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, 4} and all(math.isfinite(r.whitened) for r in got)
    assert all(r.deviation is None for r in got if r.vec_id in (1, 2, 3))
    border = np.array([[2**31, 2**31, 2**31], [1, -2, 3], [-(2**31), 2**30, 0]], np.int64)
    assert whitening.deviations(border) == [None, 14, 2**62 + 2**60]
    assert whitening.deviations(np.array([[2**63, 1], [3, 4]], object)) == [None, 25]


def test_triangular_solve():
    rng = np.random.default_rng(5)
    r, a = np.triu(rng.normal(size=(7, 7))) + 5 * np.eye(7), rng.normal(size=(20, 7))
    assert np.allclose(whitening.solve_right(a, r) @ r, a)
    singular = np.diag([1.0, 0.0])
    f = whitening.triangular_factor(singular, 10, shift=False)
    assert f[1, 1] > 0 and np.allclose(f.T @ f, singular, atol=1e-5)
