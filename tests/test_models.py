"""Penalties, scalers, stored matrices, screening, grouped selection and noise against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from siftwell.functions import dummies, solvers
from siftwell.operators import linear, penalties, scaling
from siftwell.operators.matrix import to_long
from siftwell.plans import selectors as S
from siftwell.sources import store


@pytest.fixture(scope="module")
def data():
    r = np.random.RandomState(11)
    x = r.randn(90, 12) @ np.diag(np.linspace(0.5, 3, 12)) + r.randn(12)
    x[:, 7] = 4.0
    return x, x[:, [1, 2, 3]] @ [5, -3, 2] + 2 * r.randn(90) + 1


def framed(spark, x, y):
    return spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(len(x))], "row_id bigint, features array<double>, y double")


@pytest.mark.parametrize("alpha", [0.0, 0.3, 1.0])
def test_elastic_net_is_optimal(spark, data, alpha):
    x, y = data
    path = penalties.elastic_net(framed(spark, x, y), "y", alpha, n_lambda=30)
    sd, ys = x.std(0), y.std()
    z = np.where(sd > 0, (x - x.mean(0)) / np.where(sd > 0, sd, 1), 0)
    for lam, beta, a in zip(path.lambdas / ys, path.beta, path.intercept, strict=True):
        b = beta * sd / ys
        g = z.T @ ((y - y.mean()) / ys - z @ b) / len(y) - lam * (1 - alpha) * b
        on = np.abs(b) > 1e-9
        assert np.allclose(g[on], lam * alpha * np.sign(b[on]), atol=1e-5) and (np.abs(g[~on]) <= lam * alpha + 1e-5).all()
        assert a == pytest.approx(y.mean() - beta @ x.mean(0)) and beta[7] == 0
    assert (np.diff(path.lambdas) < 0).all() and path.dev_ratio[-1] > 0.5
    got = penalties.predict(framed(spark, x, y), path, 5).orderBy("row_id").collect()
    assert np.allclose([r.prediction for r in got], x @ path.beta[5] + path.intercept[5])


def folds_of(frame, folds, seed):
    rows = frame.select("row_id", F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(folds)).alias("f")).orderBy("row_id").collect()
    return np.array([r.f for r in rows])


def test_cross_validation(spark, data):
    """Fold errors from cross products are those of refitting on rows."""
    x, y = data
    frame = framed(spark, x, y)
    f = folds_of(frame, 5, 3)
    v = penalties.elastic_net_cv(frame, "y", 0.0, folds=5, n_lambda=9, seed=3)
    want = np.zeros((5, 9))
    for k in range(5):
        a, b, t, u = x[f != k], x[f == k], y[f != k], y[f == k]
        sd = np.where(a.std(0) > 0, a.std(0), 1)
        z = (a - a.mean(0)) / sd
        for i, lam in enumerate(v.lambdas):
            beta = np.linalg.solve(z.T @ z / len(a) + lam / t.std() * np.eye(12), z.T @ (t - t.mean()) / len(a))
            want[k, i] = ((u - t.mean() - (b - a.mean(0)) / sd @ beta) ** 2).mean()
    assert np.allclose(v.error, want.mean(0)) and np.allclose(v.se, want.std(0, ddof=1) / math.sqrt(5))
    assert v.at_min == v.lambdas[v.error.argmin()] and v.at_1se == max(v.lambdas[v.error <= v.error.min() + v.se[v.error.argmin()]])

    r = penalties.ridge_cv(frame, "y", folds=5, n_lambda=7, seed=3)
    for k in range(5):
        a, t = x[f != k], y[f != k]
        norm = np.linalg.norm(a - a.mean(0), axis=0)
        norm = np.where(norm > 1e-9, norm, 1)
        z = (a - a.mean(0)) / norm
        for i, lam in enumerate(r.lambdas):
            beta = np.linalg.solve(z.T @ z + lam * np.eye(12), z.T @ (t - t.mean())) / norm
            want[k, i] = ((y[f == k] - t.mean() - (x[f == k] - a.mean(0)) @ beta) ** 2).mean()
    assert np.allclose(r.error, want[:, :7].mean(0)) and (np.diff(r.lambdas) > 0).all()


def test_informed_cross_validation(spark, data):
    x, y = data
    frame, k = framed(spark, x, y), S.group_penalty(np.arange(12) // 3)
    v = penalties.informed_cv(frame, "y", k, folds=4, n_lambda2=4, n_lambda1=12)
    assert v.at_1se >= v.at_min and v.error.min() < 0.5 * y.var()
    t, free = penalties.tikhonov_cv(frame, "y", k, folds=4, n_lambda=6)
    assert t.error.min() < y.var() and not free
    with pytest.raises(ValueError):
        penalties.elastic_net_cv(frame, "y", folds=1)
    with pytest.raises(ValueError):
        penalties.elastic_net(frame.withColumn("y", F.lit(float("nan"))), "y")


@pytest.mark.parametrize("kind", ["zscore", "l1", "l2"])
@pytest.mark.parametrize("center", [True, False])
def test_scalers(spark, data, tmp_path, kind, center):
    x, y = data
    frame = framed(spark, x, y)
    s = scaling.fit(frame, kind, center, threshold=1e-6)
    z = x - x.mean(0) if center else x
    size = {"zscore": np.sqrt((z**2).sum(0) / 89), "l1": np.abs(z).sum(0), "l2": np.linalg.norm(z, axis=0)}[kind]
    assert s.dropped == ([7] if center else [])
    got = np.array([r.features for r in s.transform(frame).orderBy("row_id").collect()])
    assert np.allclose(got, z / np.where(size < 1e-6, 1, size))
    s.save(spark, f"{tmp_path}/s")
    again = scaling.Scaler.load(spark, f"{tmp_path}/s", kind)
    assert np.allclose([r.features for r in again.inverse(again.transform(frame)).orderBy("row_id").collect()], x) and again.dropped == s.dropped
    with pytest.raises(ValueError):
        scaling.Scaler.load(spark, f"{tmp_path}/s", "other")
    moved, mean = scaling.center_y(frame, "y")
    assert mean == pytest.approx(y.mean()) and np.allclose([r.y for r in scaling.decenter_y(moved, "y", mean).orderBy("row_id").collect()], y)


def test_store(spark, data, tmp_path):
    frame = framed(spark, *data)
    store.save_matrix(frame, f"{tmp_path}/m", 3)
    x = store.open_matrix(spark, f"{tmp_path}/m")
    assert store.shape(x) == (90, 12)
    got = store.view(x, (5, 8), (2, 4)).orderBy("row_id").collect()
    assert [r.row_id for r in got] == [5, 6, 7] and np.allclose([r.features for r in got], data[0][5:8, 2:4])
    assert np.allclose([r.features for r in store.view(x, None, [9, 0]).orderBy("row_id").collect()], data[0][:, [9, 0]])
    assert to_long(store.view(x, (0, 0))).count() == 0


@pytest.mark.parametrize("noise", linear.NOISE)
def test_noise(spark, noise):
    frame = linear.synthetic(spark, 1500, {0: 2.0}, 2, 4.0, 3, noise=noise, df=6.0, rho=0.6)
    rows = frame.orderBy("row_id").collect()
    e = np.array([r.y - 2 * r.features[0] for r in rows])
    assert e.var() == pytest.approx(1.0, rel=0.3) and abs(e.mean()) < 0.2
    lag = np.corrcoef(e[1:], e[:-1])[0, 1]
    assert lag == pytest.approx(0.6, abs=0.08) if noise == "ar1" else abs(lag) < 0.1
    assert np.allclose([r.y for r in frame.repartition(5).orderBy("row_id").collect()], [r.y for r in rows])


def test_grouped_dummies():
    r = np.random.RandomState(1)
    m = np.repeat(r.randn(4000, 3), 2, axis=1) + 0.5 * r.randn(4000, 6)
    m = (m - m.mean(0)) / m.std(0)
    d = dummies.dummies(4000, 6, 2, 1, 5, factors=dummies.cluster_factors(m, np.arange(6) // 2))
    want = np.where(np.equal.outer(np.arange(6) // 2, np.arange(6) // 2), np.corrcoef(m, rowvar=False), 0)
    assert d.shape == (4000, 12) and np.abs(np.cov(d[:, 6:], rowvar=False) - want).max() < 0.1
    with pytest.raises(ValueError):
        dummies.dummies(10, 2, 1, 0, 1, "permutation", factors=[])


def test_screening(spark):
    r = np.random.RandomState(7)
    x = r.randn(150, 30)
    y = x[:, [1, 2, 3]] @ [5, -3, 2] + r.randn(150)
    frame = framed(spark, x, y).withColumn("z", F.col("features")[9] * 3 + F.col("y") * 0.001)
    c = S.Control(k=10, seed=2)
    found, rate = S.screen(frame, "y", c)
    assert {1, 2, 3} <= set(found.tolist()) and rate == 1 / len(found)
    boot, _ = S.screen(frame, "y", c, bootstrap=True)
    assert len(boot) <= len(found) and {1, 2} <= set(boot.tolist())
    many = S.screen_many(frame, ["y", "z"], c)
    assert {1, 2, 3} <= set(many["y"][0].tolist()) and 9 in many["z"][0] and all(how in ("ordinary", "bootstrap", "full") for _, how in many.values())


@pytest.mark.parametrize("dependence", ["ar1", "equi", "block_equi"])
def test_screening_under_dependence(dependence):
    r = np.random.RandomState(4)
    x = r.randn(80, 11) + r.randn(80, 1)
    m = x - x.mean(0)
    phi = r.randint(0, 21, 11) / 20
    phi[0] = 1.0
    if dependence == "ar1":
        rho = min(0.999, max(0.001, abs(np.mean([sum(a * b for a, b in zip(row[1:], row[:-1])) / sum(v * v for v in row) for row in m]))))
        reach = max(1, math.ceil(math.log(0.02) / math.log(rho)))
        near = [[k for k in range(11) if 0 < abs(j - k) <= reach] for j in range(11)]
    else:
        label = [0] * 11 if dependence == "equi" else [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
        near = [[k for k in range(11) if k != j and label[j] == label[k]] for j in range(11)]
    gaps = [min(abs(phi[j] - phi[k]) for k in ks) for j, ks in enumerate(near)]
    assert np.allclose(S._screen_over(phi, m, dependence, {}), [2 - (0 if g > 1.5 else g) for g in gaps])
    if dependence != "ar1":
        assert (S._screen_over(phi, np.linalg.qr(m)[0], dependence, {}) == 1).all()


def test_grouped_selection(spark):
    r = np.random.RandomState(3)
    x = np.repeat(r.randn(150, 8), 3, axis=1) + 0.3 * r.randn(150, 24)
    y = x[:, 0:3].sum(1) * 2 - x[:, 12:15].sum(1) * 2 + r.randn(150)
    s = S.select_groups(framed(spark, x, y), "y", 0.2, control=S.Control(k=10, seed=1, max_layers=4))
    true = {0, 1, 2, 12, 13, 14} & set(s.selected.tolist())
    assert len(true) >= 4 and len(s.selected) - len(true) <= 1


def test_sparse_components(spark):
    r = np.random.RandomState(5)
    x = 0.5 * r.randn(120, 16)
    x[:, :4] += 3 * r.randn(120, 1)
    c = S.sparse_components(framed(spark, x, x[:, 0]), 1, 0.1, S.Control(k=10, seed=1, max_layers=3), lambda2=0.1)
    on = np.flatnonzero(c.loadings[:, 0])
    assert len(on) and set(on.tolist()) <= {0, 1, 2, 3} and np.linalg.norm(c.loadings[:, 0]) == pytest.approx(1.0)
    assert c.adjusted_variance[0] == pytest.approx(np.var((x - x.mean(0)) @ c.loadings[:, 0], ddof=1))


def test_trace():
    r = np.random.RandomState(4)
    z = r.randn(60, 10)
    z = (z - z.mean(0)) / np.linalg.norm(z - z.mean(0), axis=0)
    y = z[:, :2] @ [9.0, -5.0] + 0.1 * r.randn(60)
    y -= y.mean()
    got = solvers.trace(z, y, solvers.SOLVERS["tlasso"](z, y))
    assert (np.diff(got["rss"]) <= 1e-9).all() and got["dof"][0] == 1 and abs(got["actions"][0][0]) == 1
    assert got["cp"][-1] == pytest.approx(got["dof"][-1] + 1) and got["r2"][-1] > 0.9
    on = set()
    for acts, active in zip(got["actions"], got["active"], strict=True):
        on = (on | {a - 1 for a in acts if a > 0}) - {-a - 1 for a in acts if a < 0}
        assert on == set(active)
