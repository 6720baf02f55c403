"""Dependence-aware selection against the formulas, in plain Python."""

import math

import numpy as np
import pytest
from siftwell.operators import calibrate, clusters
from siftwell.plans import selectors as S


def plain_levels(method, corr, phi, options):
    """Deflated phi for each level: neighbours by definition, one pair at a time."""
    p = len(corr)
    out = []
    if method == "nn":
        rhos = [k / 19 for k in range(20)]
        near = [[[k for k in range(p) if k != j and abs(corr[j][k]) >= rho] for j in range(p)] for rho in rhos]
    else:
        d = [[1 - abs(corr[j][k]) for k in range(p)] for j in range(p)]
        within = [[True] * p for _ in range(p)] if method == "bt" else [[all(g[j] == g[k] for g in options["groups"]) for k in range(p)] for j in range(p)]
        heights, label = [], list(range(p))
        for h, a, b in sorted((d[a][b], a, b) for a in range(p) for b in range(a) if within[a][b]):
            if label[a] != label[b]:
                heights.append(h)
                label = [label[b] if x == label[a] else x for x in label]
        full = [*sorted(heights, reverse=True), 0.0]
        n = min(20, p)
        cuts = [full[min(math.floor(i * (len(full) - 1) / (n - 1) + 0.5), len(full) - 1)] for i in range(n)]
        near = []
        for h in cuts:
            label = list(range(p))
            for a in range(p):
                for b in range(p):
                    if within[a][b] and a != b and d[a][b] <= h and label[a] != label[b]:
                        label = [label[b] if x == label[a] else x for x in label]
            near.append([[k for k in range(p) if k != j and label[k] == label[j]] for j in range(p)])
    for level in near:
        over = [2 - min((abs(phi[-1][j] - phi[-1][k]) for k in ks), default=0) for j, ks in enumerate(level)]
        out.append([[row[j] / over[j] for j in range(p)] for row in phi])
    return out


@pytest.fixture(scope="module")
def blocks():
    """Six blocks of four related columns; the signal is one column of each of three blocks."""
    r = np.random.RandomState(9)
    x = np.repeat(r.randn(200, 6), 4, axis=1) + 0.5 * r.randn(200, 24)
    return x, 5 * x[:, 1] - 4 * x[:, 8] + 4 * x[:, 18] + r.randn(200)


@pytest.mark.parametrize("method", ["bt", "nn", "prior_groups"])
def test_levels_follow_the_formula(blocks, method):
    m = blocks[0] - blocks[0].mean(0)
    r = np.random.RandomState(3)
    phi = np.sort(r.randint(0, 21, (4, 24)) / 20, axis=0)
    options = {"groups": [[j // 8 for j in range(24)], [j % 2 for j in range(24)]]}
    near = S.Dependence(method, m, options)
    want = plain_levels(method, np.corrcoef(m, rowvar=False).tolist(), phi.tolist(), options)
    assert np.allclose(near.adjusted(phi), want) and near.operating == 14


@pytest.mark.parametrize("reach", [1, 3, 50])
def test_window_and_whole(reach):
    phi = np.random.RandomState(reach).randint(0, 21, 30) / 20
    gap = [min(abs(phi[j] - phi[k]) for k in range(30) if k != j and abs(j - k) <= reach) for j in range(30)]
    assert np.allclose(S._gap_in_window(phi, reach), gap)
    assert np.allclose(S._gap_in_groups(phi, np.zeros(30, int)), [min(abs(phi[j] - phi[k]) for k in range(30) if k != j) for j in range(30)])


@pytest.mark.parametrize("faithful", [False, True])
def test_pick(spark, faithful):
    r = np.random.RandomState(5)
    for seed in range(20):
        fdp, counts = r.choice([0.0, 0.05, 0.2], (4, 3, 5)), r.randint(0, 4, (4, 3, 5))
        cells = [(counts[a, t, v], v, a, t) for a in range(4) for t in range(2) for v in range(5)]
        most = max((c[0] for c in cells if fdp[c[2], c[3], c[1]] <= 0.1), default=None)
        ties = [c for c in cells if c[0] == most and (faithful or fdp[c[2], c[3], c[1]] <= 0.1)]
        want = max(((v, a, t) for _, v, a, t in ties), default=None)
        got = S.pick(fdp, counts, 0.1, faithful)
        assert got == (want and (want[1], want[2], want[0]))
        if seed < 3:
            rows = [(a, t + 1, v, v / 10, float(fdp[a, t, v]), int(counts[a, t, v])) for a in range(4) for t in range(3) for v in range(5)]
            one = calibrate.pick_level(spark.createDataFrame(rows, "rho_idx int, T int, v_idx int, v double, fdp_hat double, r long"), 0.1, faithful).first()
            assert (one["rho_idx"], one["T"] - 1, round(one["v"] * 10)) == got


def framed(spark, x, y):
    return spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(len(x))], "row_id bigint, features array<double>, y double")


@pytest.mark.parametrize("method", ["bt", "nn", "prior_groups"])
def test_selection_in_blocks(spark, blocks, method):
    c = S.Control(k=10, seed=3, options={"groups": np.arange(24) // 4})
    s = S.select(framed(spark, *blocks), "y", 0.1, c, method)
    assert s.selected.tolist() == [1, 8, 18] and s.rho in s.rho_grid


def test_selection_along_columns(spark):
    r = np.random.RandomState(2)
    x = r.randn(200, 40)
    for j in range(1, 40):
        x[:, j] = 0.6 * x[:, j - 1] + 0.8 * x[:, j]
    y = 5 * x[:, 4] - 4 * x[:, 19] + 4 * x[:, 33] + r.randn(200)
    assert S.select(framed(spark, x, y), "y", 0.1, S.Control(k=10, seed=3), "ar1").selected.tolist() == [4, 19, 33]


def test_a_lone_column_is_halved(spark):
    """On unrelated columns of equal frequency no level of bt leaves all three of a signal, so bt selects at most two."""
    r = np.random.RandomState(1)
    m = r.randn(150, 40)
    phi = np.full((1, 40), 0.1)
    phi[0, [1, 2, 3]] = 1.0
    levels = np.array(plain_levels("bt", np.corrcoef(m, rowvar=False).tolist(), phi.tolist(), {}))
    assert np.allclose(S.Dependence("bt", m - m.mean(0), {}).adjusted(phi), levels)
    assert (levels[:, 0, [1, 2, 3]] > 0.5).sum(1).max() < 3


@pytest.mark.parametrize("method", clusters.LINKAGES)
def test_trees(method):
    """Merge heights against the definitions, from sets of points."""
    x = np.random.RandomState(6).randn(9, 12)
    d = ((x[:, :, None] - x[:, None, :]) ** 2).sum(0)
    center = {j: x[:, j] for j in range(12)}
    sets, weights, want = {j: [j] for j in range(12)}, {j: {j: 1.0} for j in range(12)}, []

    def apart(a, b):
        pairs = d[np.ix_(sets[a], sets[b])]
        if method in ("ward", "centroid", "median"):
            u, v = (center[k] if method == "median" else x[:, sets[k]].mean(1) for k in (a, b))
            size = 2 * len(sets[a]) * len(sets[b]) / (len(sets[a]) + len(sets[b])) if method == "ward" else 1
            return size * ((u - v) ** 2).sum()
        if method == "wpgma":
            return sum(w * v * d[i, j] for i, w in weights[a].items() for j, v in weights[b].items())
        return {"single": pairs.min, "complete": pairs.max, "average": pairs.mean}[method]()

    while len(sets) > 1:
        h, a, b = min((apart(a, b), a, b) for a in sets for b in sets if a < b)
        want.append((h, sorted(sets[a] + sets[b])))
        sets[a] = sets[a] + sets.pop(b)
        center[a] = (center[a] + center[b]) / 2
        weights[a] = {i: w / 2 for i, w in (*weights[a].items(), *weights[b].items())}
    tree = clusters.tree(d, method)
    assert np.allclose([m.distance for m in tree], sorted(h for h, _ in want))
    assert [m.step for m in tree] == list(range(11)) and tree[-1].size == 12 and all(m.cluster1 < m.cluster2 < 12 + m.step for m in tree)
    if method not in ("centroid", "median"):  # no inversions: cuts are those of the merges in order
        for k in (1, 2, 5, 12):
            label = list(range(12))
            for _, of in want[: 12 - k]:
                label = [min(of) if j in of else g for j, g in enumerate(label)]
            got = clusters.cut(tree, 12, k)
            assert len(set(got)) == k and all((got[i] == got[j]) == (label[i] == label[j]) for i in range(12) for j in range(12))
    assert list(dict.fromkeys(clusters.cut(tree, 12, 4).tolist())) == [0, 1, 2, 3]


def test_tree_of_points_on_a_line(spark):
    frame = spark.createDataFrame([(0, [0.0, 2.0, 5.0, 10.0, 16.0]), (1, [0.0] * 5)], "row_id bigint, features array<double>")
    got = [tuple(r) for r in clusters.cluster(frame, "single", "sq_euclidean").orderBy("step").collect()]
    assert got == [(0, 0, 1, 4.0, 2), (1, 2, 5, 9.0, 3), (2, 3, 6, 25.0, 4), (3, 4, 7, 36.0, 5)]
    assert [r[3] for r in clusters.cluster(frame, "average", "sq_euclidean").orderBy("step").collect()] == [4.0, 17.0, 36.0, 127.0]
    with pytest.raises(ValueError, match="squared"):
        clusters.cluster(frame, "ward", "correlation")
