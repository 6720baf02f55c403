"""Ridge, decompositions and synthetic designs against dense numpy."""

import numpy as np
import pytest
from siftwell.operators import linear as L

SCHEMA = "row_id bigint, features array<double>, y double"


def frame(spark, x, y=None):
    y = np.zeros(len(x)) if y is None else y
    return spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], SCHEMA)


def stacked(df, column):
    return np.array([r[column] for r in df.orderBy("row_id").collect()])


@pytest.mark.parametrize(("n", "p", "lam"), [(40, 6, 0.0), (40, 6, 2.5), (5, 9, 1.0)])
def test_ridge(spark, n, p, lam):
    r = np.random.default_rng(n + p)
    x, y = r.standard_normal((n, p)), r.standard_normal(n)
    want = np.linalg.solve(x.T @ x + lam * np.eye(p), x.T @ y)
    assert np.allclose(L.ridge(frame(spark, x, y), "y", lam), want)


def test_ridge_refuses(spark):
    x = np.ones((3, 2))
    with pytest.raises(ValueError, match="negative"):
        L.ridge(frame(spark, x), "y", -1.0)
    with pytest.raises(ValueError, match="finite"):
        L.ridge(frame(spark, x).filter("row_id < 0"), "y", 1.0)
    with pytest.raises(ValueError, match="finite"):
        L.ridge(frame(spark, np.array([[1.0, np.nan]])), "y", 1.0)


@pytest.mark.parametrize(("center", "normalize"), [(True, False), (False, False), (True, True)])
def test_components(spark, center, normalize):
    x = np.random.default_rng(3).standard_normal((30, 4)) @ np.diag([4.0, 3, 2, 1]) + 1
    df = frame(spark, x)
    c = L.components(df, 4, center, normalize)
    z = x - x.mean(0) if center else x
    if normalize:
        z = z / np.linalg.norm(z, axis=0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(c.sd, s)
    assert np.allclose(c.explained, s**2 / 29)
    assert np.allclose(np.abs(c.loadings), np.abs(vt.T))
    scored = L.scores(df, c)
    assert np.allclose(np.abs(stacked(scored, "scores")), np.abs(u * s))
    assert np.allclose(np.abs(stacked(L.left_vectors(df, c), "u")), np.abs(u))
    assert np.allclose(stacked(L.restored(scored, c), "features"), x)


def test_constant_and_equal_columns(spark):
    a = np.arange(6.0)
    c = L.components(frame(spark, np.column_stack([a, a, np.full(6, 2.0)])), 3, normalize=True)
    assert np.allclose(c.sd, [np.sqrt(2), 0, 0], atol=1e-7)
    assert np.allclose(c.scale[2], 1.0)


@pytest.mark.parametrize("predictors", ["normal", "student_t", "gumbel", "ar1"])
def test_synthetic(spark, predictors):
    beta = {1: 5.0, 2: -3.0, 3: 2.0}
    df = L.synthetic(spark, 400, beta, 8, 2.0, 42, predictors, noise="student_t", df=6.0)
    x, y = stacked(df, "features"), stacked(df, "y")
    assert np.array_equal(x, stacked(L.synthetic(spark, 400, beta, 8, 2.0, 42, predictors, noise="student_t", df=6.0).repartition(3), "features"))
    signal = x[:, [1, 2, 3]] @ [5, -3, 2]
    assert 1.2 < signal.var() / (y - signal).var() < 3.5
    if predictors == "ar1":
        assert np.corrcoef(x[:, 3], x[:, 4])[0, 1] == pytest.approx(0.5, abs=0.12)


def test_synthetic_refuses(spark):
    for bad in ({"beta": {9: 1.0}}, {"snr": 0.0}, {"predictors": "cauchy"}, {"noise": "student_t", "df": 2.0}):
        with pytest.raises(ValueError):
            L.synthetic(spark, **({"n": 5, "beta": {0: 1.0}, "p": 3, "snr": 1.0, "seed": 1} | bad))
