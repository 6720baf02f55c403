"""Random dummy columns, keyed by (seed, experiment, layer), so that any task can draw them again."""

from __future__ import annotations

import numpy as np

BLOCK = 4096


def _generator(seed: int, k: int, layer: int, block: int = 0) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[(seed & 0xFFFFFFFF) << 32 | k, layer], counter=[0, 0, block, 0]))


def _sparse(g: np.random.Generator, n: int, p: int, s: float = 0.1) -> np.ndarray:
    """Exactly balanced signs at a share s of the rows of each column."""
    half = max(1, round(s * n / 2))
    column = np.concatenate([np.ones(half), -np.ones(half), np.zeros(max(0, n - 2 * half))])[:n]
    return g.permuted(np.tile(column[:, None], (1, p)), axis=0)


def _sphere(g: np.random.Generator, n: int, p: int, dim: int = 3) -> np.ndarray:
    if p % dim:
        raise ValueError("the number of columns isn't a multiple of the sphere's dimension")
    z = g.standard_normal((n, p // dim, dim))
    return (z / np.linalg.norm(z, axis=2, keepdims=True)).reshape(n, p)


_GOLDEN = (1 + 5**0.5) / 2
DISTRIBUTIONS = {
    "normal": lambda g, n, p: g.standard_normal((n, p)),
    "uniform": lambda g, n, p: g.uniform(-(3**0.5), 3**0.5, (n, p)),
    "rademacher": lambda g, n, p: g.integers(0, 2, (n, p)) * 2.0 - 1,
    "student_t": lambda g, n, p, df=5: g.standard_t(df, (n, p)) * ((df - 2) / df) ** 0.5,
    "laplace": lambda g, n, p: g.laplace(0, 0.5**0.5, (n, p)),
    "gumbel": lambda g, n, p: (g.gumbel(0, 1, (n, p)) - np.euler_gamma) * 6**0.5 / np.pi,
    "triangle": lambda g, n, p: g.triangular(-(6**0.5), 0, 6**0.5, (n, p)),
    "uniform_sphere": _sphere,
    "mammen": lambda g, n, p: np.where(g.random((n, p)) < _GOLDEN / 5**0.5, 1 - _GOLDEN, _GOLDEN),
    "sparse_rademacher": _sparse,
    "logistic": lambda g, n, p: g.logistic(0, 3**0.5 / np.pi, (n, p)),
}


def cluster_factors(m: np.ndarray, groups: np.ndarray, n: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(columns, lower factor of their covariance) of each group of standardized columns; n: of how many rows m has the products."""
    out = []
    for g in np.unique(groups):
        of = np.flatnonzero(groups == g)
        c = m[:, of].T @ m[:, of] / ((n or len(m)) - 1)
        out.append((of, np.linalg.cholesky(c + 1e-10 * np.eye(len(of)))))
    return out


def _clustered(g: np.random.Generator, n: int, p: int, factors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Normal columns with the covariance of each group."""
    out = g.standard_normal((n, p))
    for of, low in factors:
        out[:, of] = out[:, of] @ low.T
    return out


def dummies(n: int, p: int, layers: int, k: int, seed: int, strategy: str = "standard", distribution: str = "normal", factors: list | None = None, block: int | None = None) -> np.ndarray:
    """n x (layers * p) dummies of experiment k.

    standard and seeded: fresh draws for each number of layers; hconcat: a layer is the same whatever follows it;
    permutation: one base for all k, its rows shuffled by k (k = 0: as drawn); skipl draws like standard.  With
    `factors` (of cluster_factors) a layer's columns are correlated within groups.

    With `block`, only rows BLOCK * block on, at most BLOCK of them: blocks are drawn each by itself (the first like a
    design of its rows), and permutation shuffles whole blocks and the rows within each.
    """
    draw = DISTRIBUTIONS[distribution] if factors is None else lambda g, n, p: _clustered(g, n, p, factors)
    if factors is not None and strategy.startswith("permutation"):
        raise ValueError("rows of grouped dummies aren't permuted")
    rows, at = (n, 0) if block is None else (min(BLOCK, n - BLOCK * block), block)
    if strategy.startswith("permutation"):
        source = at
        if block is not None and k and block < n // BLOCK:
            source = int(_generator(seed, k, 1 << 21).permutation(n // BLOCK)[block])
        base = np.hstack([draw(_generator(seed, 0, j, source), rows, p) for j in range(layers)])
        return base if k == 0 else base[_generator(seed, k, 1 << 20, at).permutation(rows)]
    first = 0 if strategy == "hconcat" else layers << 16
    return np.hstack([draw(_generator(seed, k, first + j, at), rows, p) for j in range(layers)])
