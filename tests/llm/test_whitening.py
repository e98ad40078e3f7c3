import math

import numpy as np
import pytest
from texts import SF_DIR

from hindcast.llm import queries, whitening

NAMES = "vec_id long, embedding array<float>, n long, component string, vector string"


def brute(rows):
    """``{vec_id: deviation}``, axes, eigenvalues, trace and covariance from whole numbers, in long double."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    exact = n * x - sums
    z = exact.astype(np.longdouble) / n
    cov = (z.T @ z / n).astype(np.float64)
    values, axes = np.linalg.eigh(cov)
    return n, (exact * exact).sum(axis=1), z.astype(np.float64), values[::-1], axes[:, ::-1], cov


def check(spark, rows, most=32):
    df = spark.createDataFrame([(i, v, None, "a", "b") for i, v in rows], NAMES).repartition(3)
    fit = whitening.fit_whitening(df)
    got = whitening.whiten(df, fit, most).collect()
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, deviation, z, values, axes, _ = brute(good)
    rank = int((values > 1e-9 * values[0]).sum()) if values[0] > 0 else 0
    count = min(most, rank)
    assert len(got) == n * count
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n
    for k in range(count):
        mine = np.array([by_id[i][k + 1].whitened for i, _ in good])
        theirs = z @ axes[:, k] / np.sqrt(values[k])
        if k in (0, count - 1) or min(values[k - 1] - values[k], values[k] - values[k + 1]) > 1e-6 * values[0]:
            sign = np.sign(mine @ theirs)
            assert np.abs(mine - sign * theirs).max() < 1e-6
        explained = by_id[good[0][0]][k + 1].explained
        assert math.isclose(explained, values[k] / values.sum(), rel_tol=1e-8)
    for (i, _), d in zip(good, deviation, strict=True):
        if count:
            assert by_id[i][1].deviation == d
    assert fit.identity_error(most) < 1e-6
    return fit


def vectors(n, d, seed=1, scale=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * (np.geomspace(1, 0.2, d) if scale is None else scale)
    return [[float(np.float32(c)) for c in row] for row in x]


def test_against_eigenvectors(spark):
    check(spark, list(enumerate(vectors(200, 12))))


def test_far_from_the_origin_and_badly_conditioned(spark):
    rows = vectors(300, 6, scale=np.array([1000.0, 300, 10, 1, 0.5, 0.1]))
    check(spark, [(i, [c + 4096.0 for c in v]) for i, v in enumerate(rows)])


def test_constant_and_repeated_dimensions_are_no_components(spark):
    rows = [[*v, 2.5, v[0], v[1]] for v in vectors(100, 5)]
    fit = check(spark, list(enumerate(rows)))
    assert fit.axes.shape[1] == 5


def test_fewer_vectors_than_dimensions(spark):
    fit = check(spark, list(enumerate(vectors(4, 9))))
    assert fit.axes.shape[1] == 3


def test_unusable_vectors_are_left_out(spark):
    rows = list(enumerate(vectors(50, 4)))
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [math.nan, 0, 0, 0]), (103, [math.inf, 0, 0, 0])]
    check(spark, rows + [(i, v and [c if c is None else float(c) for c in v]) for i, v in odd])
    df = spark.createDataFrame([(i, v, None, "a", "b") for i, v in [*rows, (7, [1.0]), (8, []), (None, rows[0][1])]], NAMES)
    got = whitening.whiten(df, whitening.fit_whitening(df)).collect()
    assert len(got) == 51 * 4 and {r.n for r in got} == {51} and any(r.vec_id is None for r in got)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (1, [0.5, 0.25])]):
        df = spark.createDataFrame([(i, v, None, "a", "b") for i, v in rows], NAMES)
        fit = whitening.fit_whitening(df)
        assert whitening.whiten(df, fit).count() == 0


def test_too_large_entries_raise(spark):
    df = spark.createDataFrame([(1, [1e30], None, "a", "b"), (2, [0.0], None, "a", "b")], NAMES)
    with pytest.raises(Exception, match="too large"):
        whitening.fit_whitening(df)


def test_query(spark):
    got = queries.op13_embedding_whitening(spark, SF_DIR)
    rows = queries.table(spark, SF_DIR, "embeddings").count()
    assert got.count() == rows * 32
    assert got.agg({"identity_error": "max"}).first()[0] < 1e-9
