import math
import random

import numpy as np
import pytest

from stockbook.llm.whitening import deviations, inertia, leading, op13_whitening, whiten


@pytest.mark.parametrize("kind", ["spread", "clusters", "low rank", "close", "one", "two-by-two pivots"])
def test_leading_eigenpairs(kind):
    rng = np.random.default_rng(3)
    d = 1 if kind == "one" else 24
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    values = {"clusters": np.repeat([4.0, 2.0, 1.0], 8), "low rank": np.where(np.arange(24) < 3, 5.0 - np.arange(24), 0), "close": 1 + np.arange(24) * 1e-9, "two-by-two pivots": np.tile([3.0, -3.0], 12) * (1 + np.arange(24))}.get(kind, rng.random(d))
    m = q @ np.diag(values) @ q.T
    m = (m + m.T) / 2
    got, axes = leading(m, 10)
    assert np.allclose(got, np.linalg.eigvalsh(m)[::-1][:10], atol=1e-12)
    assert np.allclose(axes @ axes.T, np.eye(len(axes)), atol=1e-13) and np.allclose(axes @ m, got[:, None] * axes, atol=1e-12)


def test_inertia_counts():
    rng = np.random.default_rng(5)
    m = rng.normal(size=(12, 12))
    m = m + m.T
    np.fill_diagonal(m, 0)  # every first pivot is two by two
    e = np.linalg.eigvalsh(m)
    for shift in (*((e[:-1] + e[1:]) / 2), e[0] - 1, e[-1] + 1):
        assert inertia(m, shift) == (e > shift).sum()


def rows_of(spark, vectors):
    return spark.createDataFrame([(k, v, "x") for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, whitened string")


def held(spark, vectors, kept, most=32):
    """Against numpy on the vectors that count."""
    got = whiten(rows_of(spark, vectors), most=most).toPandas().sort_values(["key", "component"])
    x = np.floor(64 * np.array([vectors[i] for i in kept], float)) + 1_000_000
    n = len(x)
    c = x - x.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    w = c @ u / np.sqrt(e)
    own = got.whitened.to_numpy().reshape(n, -1)
    assert set(got.key) == set(kept) and set(got.n) == {n}
    assert np.allclose(own * np.sign((own * w).sum(axis=0)), w, atol=1e-8)
    assert np.allclose(got.explained[: own.shape[1]], e / np.trace(c.T @ c / n), rtol=1e-9) and got.identity_error.max() < 1e-10
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, x.astype(object).sum(axis=0), strict=True)) for r in x]
    assert list(got.deviation.to_numpy().reshape(n, -1)[:, 0]) == exact


def test_whitening_leaves_out_what_does_not_count(spark):
    r = random.Random(1)
    good = [[r.gauss(0, 1) for _ in range(6)] for _ in range(80)] + [[0.5] * 6] * 40
    bad = [None, [], [None] * 6, [math.nan] + [0.0] * 5, [math.inf] + [0.0] * 5, [-math.inf] + [0.0] * 5, [1.0] * 5, [1e300] + [0.0] * 5]
    held(spark, good + bad, range(120), most=4)


def test_whitening_of_large_numbers_is_exact(spark):
    r = random.Random(2)
    held(spark, [[r.gauss(0, 1) + 40_000 * (i % 2), r.gauss(0, 300_000)] for i in range(30)], range(30))


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_nothing_to_scale_gives_no_rows(spark, vectors):
    assert whiten(rows_of(spark, vectors)).count() == 0


def test_rank_below_the_dimensions(spark):
    got = whiten(rows_of(spark, [[float(i), 2.0 * i, 7.0] for i in range(9)])).toPandas()
    assert set(got.component) == {1} and np.isclose((got.whitened**2).mean(), 1) and np.allclose(got.explained, 1)


def test_deviation_beyond_a_long_is_null():
    assert deviations(np.array([[0], [1 << 40]]), 2, [1 << 40]).to_pylist() == [None, None]


def test_query(spark):
    out = op13_whitening(spark, "/root/testdata/sf0.001")
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 500 * 32 and out.agg({"identity_error": "max"}).first()[0] < 1e-10
