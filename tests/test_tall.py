"""Designs that stay on the executors, against the same designs gathered on the driver."""

import numpy as np
import pytest
from siftwell.functions import dummies as D
from siftwell.operators.tall import tall
from siftwell.plans import selectors as S

#: What was refused beyond MAX_BROADCAST: (query, its control).
REFUSED = {
    "select_skipl": {"strategy": "skipl", "max_layers": 4},
    "select_tomp": {"solver": "tomp"},
    "found_tgp": {"solver": "tgp", "seed": 5},
    "select_tncgmp": {"solver": "tncgmp"},
    "select_tmp": {"solver": "tmp"},
    "found_tacgp": {"solver": "tacgp", "seed": 5},
    "found_tomp": {"solver": "tomp", "seed": 5},
    "select_tstepwise": {"solver": "tstepwise"},
    "select_tools": {"solver": "tools"},
    "found_tools": {"solver": "tools", "seed": 5},
    "found_tenet": {"solver": "tenet", "seed": 5},
    "select_tacgp": {"solver": "tacgp"},
    "found_tmp": {"solver": "tmp", "seed": 5},
    "select_tlasso": {"solver": "tlasso"},
    "select_tgp": {"solver": "tgp"},
}


def framed(spark, x, y, ids):
    rows = [(int(i), v.tolist(), float(t)) for i, v, t in zip(ids, x, y, strict=True)]
    return spark.createDataFrame(rows, "row_id bigint, features array<double>, y double").repartition(5)


@pytest.fixture(scope="module")
def frame(spark):
    """Of 12 columns two are copies but for the sign and one is constant; three drive y."""
    r = np.random.RandomState(3)
    x = r.randn(3000, 12) + 5
    x[:, 5], x[:, 7], x[:, 9] = x[:, 1], -x[:, 2], 4
    return framed(spark, x, x[:, [1, 2, 3]] @ [1, -0.6, 0.4] + 4 * r.randn(3000), r.permutation(3000) * 7 - 100).cache()


@pytest.mark.parametrize("query", sorted(REFUSED))
def test_selection_beyond_what_is_broadcast(frame, monkeypatch, query):
    c = S.Control(**{"k": 6, "seed": 2} | REFUSED[query])
    want = S.select(frame, "y", 0.1, c)
    monkeypatch.setattr(S, "GATHERED", 0, raising=False)
    monkeypatch.setattr(S, "MAX_BROADCAST", 0)
    got = S.select(frame, "y", 0.1, c)
    assert got.selected.tolist() == want.selected.tolist() == ([1, 2, 3, 5, 7] if c.solver == "tenet" else [1, 2, 3])  # a net takes copies too
    assert (got.layers, got.t_stop, got.v) == (want.layers, want.t_stop, want.v) and np.array_equal(got.phi, want.phi)
    assert np.allclose(got.phi_prime, want.phi_prime) and np.allclose(got.fdp_hat, want.fdp_hat)


@pytest.mark.parametrize("kw", [
    {"strategy": "permutation"}, {"strategy": "hconcat"}, {"scaling": "zscore", "solver": "tlasso"}, {"distribution": "sparse_rademacher"}, {"solver": "tlars", "dependence": "ar1"},
    {"solver": "tlars", "dependence": "equi"}, {"solver": "tlars", "dependence": "nn"}])
def test_other_ways_to_draw_and_to_deflate(frame, monkeypatch, kw):
    kw = dict(kw)
    how = kw.pop("dependence", None)
    c = S.Control(k=6, seed=2, **kw)
    want = S.select(frame, "y", 0.1, c, how)
    monkeypatch.setattr(S, "GATHERED", 0, raising=False)
    monkeypatch.setattr(S, "MAX_BROADCAST", 0)
    got = S.select(frame, "y", 0.1, c, how)
    assert got.selected.tolist() == want.selected.tolist() and np.allclose(got.phi, want.phi)
    levels = -1 if how == "nn" else None  # whether copies meet at a correlation of one is up to rounding
    assert np.allclose(got.fdp_hat[:levels], want.fdp_hat[:levels])


def test_groups_and_screening(frame, monkeypatch):
    c = S.Control(k=6, seed=2, max_layers=2)
    wanted = lambda: (S.screen_many(frame, ["y"], c), S.screen(frame, "y", c, "ar1"), S.select_groups(frame, "y", 0.1, control=c, lambda2=0.1), S.centered(frame))
    many, one, groups, (raw, n) = wanted()
    monkeypatch.setattr(S, "GATHERED", 0, raising=False)
    monkeypatch.setattr(S, "MAX_BROADCAST", 0)
    many2, one2, groups2, (raw2, n2) = wanted()
    assert many["y"][0].tolist() == many2["y"][0].tolist() and many["y"][1] == many2["y"][1] and one[0].tolist() == one2[0].tolist()
    assert groups.selected.tolist() == groups2.selected.tolist() and n == n2 and np.allclose(raw.T @ raw, raw2.T @ raw2)


@pytest.mark.parametrize("strategy,layers", [("standard", 2), ("permutation", 1)])
def test_products_over_many_blocks(spark, strategy, layers):
    r = np.random.RandomState(5)
    n, p = 3 * D.BLOCK + 500, 4
    x, ids = r.randn(n, p) * [1, 50, 1e-3, 1] + [0, 1e4, 2, 3], np.sort(r.choice(10**6, n))  # some ids are repeated
    x[:, 3] = x[:, 0] + 1e-3 * x[:, 3]
    y = x @ [1, 0.1, 100, 0] + r.randn(n)
    order = np.lexsort((x[:, 1], x[:, 0], ids))
    c = S.Control(k=2, seed=4, strategy=strategy)
    t = tall(framed(spark, x, y, ids), ["y"], n, p)
    blocks = -(-n // D.BLOCK)
    unit = lambda m: (m - m.mean(0)) / np.linalg.norm(m - m.mean(0), axis=0)
    for k, low in [(row["k"], np.frombuffer(row["d"]).reshape(-1, layers * p)) for row in t.drawn(c, layers).collect()]:
        d = np.vstack([D.dummies(n, p, layers, k, 4, strategy, block=b) for b in range(blocks)])
        whole, ends = np.hstack([unit(x[order]), unit(d)]), y[order] - y.mean()
        z = np.hstack([np.vstack([t.triangle, np.zeros((layers * p, p))]), low])
        assert z.shape == (p + 1 + layers * p, p + layers * p) and np.allclose(z.T @ z, whole.T @ whole, atol=1e-11)
        assert np.allclose(z.T @ np.append(t.ends[:, 0], np.zeros(layers * p)), whole.T @ ends, atol=1e-9 * np.linalg.norm(ends))
        if strategy == "permutation":
            base = np.vstack([D.dummies(n, p, layers, 0, 4, strategy, block=b) for b in range(blocks)])
            assert np.allclose(np.sort(base, 0), np.sort(d, 0)) and (k == 0) == np.allclose(base, d)
    t.free()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() <= 1  # the module's frame


@pytest.mark.parametrize("name", sorted(D.DISTRIBUTIONS))
def test_blocks_of_dummies(name):
    n = D.BLOCK + 100
    blocks = [D.dummies(n, 6, 1, 3, 5, distribution=name, block=b) for b in range(2)]
    assert [len(b) for b in blocks] == [D.BLOCK, 100] and not np.allclose(blocks[0][:100], blocks[1])
    assert np.array_equal(blocks[0], D.dummies(D.BLOCK, 6, 1, 3, 5, distribution=name))
