"""Reference operators: every query against its SQL, kernels against each other, and selection on planted signals."""

import math

import duckdb
import numpy as np
import pytest
from siftwell import oracles, queries
from siftwell.functions import dummies, solvers
from siftwell.operators import calibrate
from siftwell.plans import selectors

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(oracles.ORACLES[name])
    names = [c[0] for c in want.description]
    frame = queries.QUERIES[name](spark, SF)
    assert sorted(frame.columns) == sorted(names)
    got = sorted(tuple(plain(v) for v in r) for r in frame.select(*names).collect())
    want = sorted(tuple(plain(float(v) if v is not None and v.__class__.__name__ == "Decimal" else v) for v in r) for r in want.fetchall())
    assert len(got) == len(want)
    assert all(a == b or math.isclose(a, b, abs_tol=2e-5) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


@pytest.fixture(scope="module")
def problem():
    r = np.random.RandomState(4)
    x = r.randn(120, 30)
    y = x[:, [1, 2, 3]] @ [5, -3, 2] + 2 * r.randn(120)
    d = dummies.dummies(120, 30, 1, 0, 7)
    z = np.hstack([x - x.mean(0), d - d.mean(0)])
    return z / np.linalg.norm(z, axis=0), y - y.mean()


def path(solver, problem, **k):
    return list(solvers.SOLVERS[solver](*problem, **k))


def test_lasso_meets_its_optimality_conditions(problem):
    z, y = problem
    for beta in path("tlasso", problem)[:40]:
        c = z.T @ (y - z @ beta)
        on = np.abs(beta) > 1e-12
        assert np.allclose(np.abs(c[on]), np.abs(c).max(), atol=1e-6) and (np.sign(c[on]) == np.sign(beta[on])).all()


def test_equivalent_kernels(problem):
    same = lambda a, b: all(np.allclose(x, y, atol=1e-6) for x, y in zip(a[:15], b[:15]))
    assert same(path("tenet", problem, lambda2=0.0), path("tlasso", problem))
    groups = np.arange(30) // 5
    assert same(path("tcienet", problem, penalty=np.eye(30) * 0.0), path("tlasso", problem))
    blocks = (groups[:, None] == groups) / 5.0
    assert same(path("tcienet", problem, penalty=blocks), path("tienet", problem, groups=groups))
    assert same(path("tncgmp", problem), path("tmp", problem)) and same(path("tncgmp_full", problem), path("tomp", problem))


@pytest.mark.parametrize("solver", sorted(solvers.SOLVERS))
def test_residuals_fall(problem, solver):
    z, y = problem
    rss = [((y - z @ b) ** 2).sum() for b in path(solver, problem, groups=np.arange(30) // 5, penalty=np.eye(30))[:12]]
    assert rss[-1] < 0.7 * (y @ y)
    assert {1, 2} <= set(solvers.supports(iter(path(solver, problem, groups=np.arange(30) // 5, penalty=np.eye(30))), 30, 1)[0].tolist())


def test_adaptive_steps_lie_between_least_angle_and_least_squares(problem):
    z, y = problem
    small = path("tafs", problem, rho=0.01)
    entered = list(dict.fromkeys(j for b in small for j in np.flatnonzero(b).tolist()))[:8]
    angles = path("tlars", problem)[:8]
    assert entered == list(dict.fromkeys(j for b in angles for j in np.flatnonzero(b).tolist()))
    sixth = next(b for b in small if np.count_nonzero(b) == 6)  # as the sixth enters, coefficients are those of five
    assert np.abs(z @ (sixth - angles[4])).max() < 0.05 * np.abs(y).max()
    full = path("tafs", problem, rho=1.0)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(full[:8], path("tomp", problem)[:8], strict=True))


def test_adaptive_steps_leave_a_related_column_out():
    """Column 0 has no part in y but is related to one that has: what is left of that one isn't taken for a signal of 0."""
    r = np.random.RandomState(12)
    x, d = r.randn(20000, 20), r.randn(20000, 40)
    x[:, 0] += 0.2 * x[:, 1]
    x, d, noise = x - x.mean(0), d - d.mean(0), r.uniform(-1, 1, 20000)
    noise -= x @ np.linalg.lstsq(x, noise, rcond=None)[0]  # of which no column has a share by chance
    y = x[:, [1, 2, 3]] @ [5, -3, 2] + noise
    z = np.hstack([x, d]) / np.linalg.norm(np.hstack([x, d]), axis=0)
    for solver in ("tomp", "tlars", "tafs"):
        assert solvers.supports(solvers.SOLVERS[solver](z, y - y.mean()), 20, 1)[0].tolist() == [1, 2, 3]


@pytest.mark.parametrize("solver", ["tlars", "tlasso", "tstagewise"])
def test_equal_columns_leave_the_path_alone(solver):
    r = np.random.RandomState(8)
    x, d = r.randn(9000, 10), r.randn(9000, 20)
    x[:, 4], x[:, 5], x[:, 9] = x[:, 3], 0, -x[:, 2]
    y = x[:, [1, 2, 3]] @ [5, -3, 2] + 2 * r.randn(9000)
    z, y, keep = np.hstack([x, d]), y - y.mean(), [j for j in range(30) if j not in (4, 5, 9)]
    z = (z - z.mean(0)) / np.maximum(np.linalg.norm(z - z.mean(0), axis=0), 1e-9)
    with_, without = (solvers.states(solvers.SOLVERS[solver](m, y), p, 1)[0] for m, p in ((z, 10), (z[:, keep], 7)))
    assert np.allclose(with_[keep], without, atol=1e-6 * np.linalg.norm(y)) and not with_[[4, 5, 9]].any()


@pytest.mark.parametrize("solver", sorted(solvers.SOLVERS))
def test_paths_on_reduced_rows(solver):
    """A tall design is read by its triangle, of as many rows as columns: every path is that of the whole design."""
    r = np.random.RandomState(8)
    x, d = r.randn(9000, 10), r.randn(9000, 20)
    x[:, 5] = 0
    if not solver.endswith(("net", "net_aug")):  # equal columns tie on a net's path, which rounding then decides
        x[:, 4], x[:, 9] = x[:, 3], -x[:, 2]
    ys = np.column_stack([x[:, [1, 2, 3]] @ [5, -3, 2] + 2 * r.randn(9000), r.randn(9000)])
    x, d, ys = x - x.mean(0), d - d.mean(0), ys - ys.mean(0)
    x, d = x / np.maximum(np.linalg.norm(x, axis=0), 1e-9), d / np.linalg.norm(d, axis=0)
    whole = np.hstack([x, d])
    z, ends = solvers.reduced(whole, ys, 10)
    assert z.shape == (32, 30) and ends.shape == (32, 2)
    assert np.allclose(z.T @ z, whole.T @ whole) and np.allclose(z.T @ ends, whole.T @ ys) and np.allclose(ends.T @ ends, ys.T @ ys)
    more = {"groups": np.arange(10) // 5, "penalty": np.eye(10)}
    split = list(solvers.states_of(lambda z, y: solvers.SOLVERS[solver](z, y, **more), whole, ys, 10, 3))
    for q in range(2):
        a = solvers.states(solvers.SOLVERS[solver](whole, ys[:, q], **more), 10, 3)
        b = solvers.states(solvers.SOLVERS[solver](z, ends[:, q], **more), 10, 3)
        assert len(a) == len(b) == len(split[q]) == 3
        assert all(np.allclose(u, v, atol=1e-6 * np.linalg.norm(ys[:, q])) for u, v in zip([*a, *a], [*b, *split[q]], strict=True))
    short = solvers.reduced(whole[:31], ys[:31], 10)
    assert np.array_equal(short[0], whole[:31]) and np.array_equal(short[1], ys[:31])


@pytest.mark.parametrize("name", sorted(dummies.DISTRIBUTIONS))
def test_dummies(name):
    a = dummies.dummies(4000, 6, 2, 3, 5, "hconcat", name)
    assert np.allclose(a[:, :6], dummies.dummies(4000, 6, 1, 3, 5, "hconcat", name))
    assert np.abs(a.mean(0)).max() < 0.1 and not np.allclose(a, dummies.dummies(4000, 6, 2, 4, 5, "hconcat", name))
    if name not in ("uniform_sphere", "sparse_rademacher"):
        assert np.allclose(a.std(0), 1, atol=0.12)


def test_permutation_keeps_the_base():
    a, b = (dummies.dummies(50, 4, 1, k, 5, "permutation") for k in (0, 3))
    assert np.allclose(np.sort(a, 0), np.sort(b, 0)) and not np.allclose(a, b)


def test_calibration_agrees_with_the_tables(spark):
    phi = queries._phi(spark, SF)
    rows = {(r.t, r.col_id): r.phi for r in phi.collect()}
    m = np.array([[rows[t, j] for j in range(64)] for t in range(5)])
    prime = selectors.deflated(m, 64)
    got = {r.col_id: r.phi_prime for r in calibrate.phi_prime(phi, 64, 64).collect()}
    assert np.allclose(prime, [got[j] for j in range(64)])


def test_selection(spark):
    r = np.random.RandomState(1)
    x = r.randn(150, 40)
    y = x[:, [1, 2, 3]] @ [5, -3, 2] + r.randn(150)
    frame = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), float(r.randn())) for i in range(150)], "row_id bigint, features array<double>, y double, noise double")
    for kw in ({}, {"dependence": "equi"}):
        s = selectors.select(frame, "y", 0.1, selectors.Control(k=10, seed=3), **kw)
        assert {1, 2, 3} <= set(s.selected.tolist()) and len(s.selected) <= 4
    # Unrelated columns of equal frequency: every level of bt halves at least one of the three (test_selection.py).
    s = selectors.select(frame, "y", 0.1, selectors.Control(k=10, seed=3), "bt")
    assert set(s.selected.tolist()) < {1, 2, 3}
    again = selectors.select(frame.repartition(7), "y", 0.1, selectors.Control(k=10, seed=3))
    assert np.allclose(again.phi, selectors.select(frame, "y", 0.1, selectors.Control(k=10, seed=3)).phi)
    assert len(selectors.select(frame, "noise", 0.1, selectors.Control(k=10, seed=3, max_layers=2)).selected) <= 1
    with pytest.raises(ValueError):
        selectors.select(frame.selectExpr("row_id", "array(double('nan')) as features", "y"), "y")
