"""Elastic nets and cross-validated penalties on cross products.

One pass over the rows gives each fold's cross products of [X, 1, y]; a training set is the total less a fold, and the
squared error on a fold is a quadratic form in its cross products.  So no fold's rows are ever gathered, and what reaches
the driver is folds x (p + 2)^2 numbers.

A row's fold is a hash of its row_id and the seed, so folds don't depend on partitioning and are equal in size up to
chance.  Defined cases: constant columns get the coefficient 0; a constant response has coefficients 0; fewer than two
rows or an empty training fold are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import check


class Path(NamedTuple):
    lambdas: np.ndarray
    beta: np.ndarray  # [lambdas, p]
    intercept: np.ndarray
    dev_ratio: np.ndarray


class Validated(NamedTuple):
    lambdas: np.ndarray
    error: np.ndarray
    se: np.ndarray
    at_min: float
    at_1se: float


def fold_products(x: DataFrame, y: str, folds: int, seed: int = 0) -> np.ndarray:
    """[folds, p + 2, p + 2]: the cross products of [X, 1, y] in each fold."""
    p = check(x)
    rows = x.select(F.concat("features", F.array(F.lit(1.0), F.col(y).cast("double"))).alias("v"), F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(folds)).cast("int").alias("fold"))
    if rows.filter(F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).limit(1).count():
        raise ValueError("the response has null or infinite values")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((folds, p + 2, p + 2))
        for b in batches:
            m, of = np.array(b.column(0).flatten(), float).reshape(b.num_rows, -1), np.array(b.column(1))
            for f in np.unique(of):
                held[f] += m[of == f].T @ m[of == f]
        f, i, j = (c.ravel().astype(np.int32) for c in np.indices(held.shape))
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(i), pa.array(j), pa.array(held.ravel())], names=["f", "i", "j", "g"])

    t = rows.mapInArrow(products, "f int, i int, j int, g double").groupBy("f", "i", "j").agg(F.sum("g").alias("g")).toArrow()  # folds x (p + 2)^2
    out = np.zeros((folds, p + 2, p + 2))
    out[np.array(t.column("f")), np.array(t.column("i")), np.array(t.column("j"))] = np.array(t.column("g"))
    return out


class _Scaled:
    """Columns and response of cross products, centered and scaled to a variance (over n) of one."""

    def __init__(self, g: np.ndarray, standardize: bool = True, intercept: bool = True) -> None:
        p = len(g) - 2
        self.n = g[p, p]
        if self.n < 2:
            raise ValueError("at least two rows are needed")
        mean = g[p] / self.n if intercept else np.zeros(p + 2)
        c = (g - self.n * np.outer(mean, mean)) / self.n
        self.sd = np.sqrt(np.maximum(np.diag(c)[:p], 0))
        self.live = self.sd > 1e-12 * max(1.0, self.sd.max(initial=0))
        self.scale = np.where(self.live, self.sd, 1.0) if standardize else np.ones(p)
        self.y_scale = math.sqrt(max(c[p + 1, p + 1], 0)) or 1.0
        self.cross = c[:p, :p] / np.outer(self.scale, self.scale)
        self.with_y = np.where(self.live, c[:p, p + 1] / self.scale / self.y_scale, 0.0)
        self.mean, self.y_mean, self.p = mean[:p], mean[p + 1], p


def _descend(s: _Scaled, beta: np.ndarray, l1: float, l2: float, tol: float, most: int) -> np.ndarray:
    """Coordinate descent; sweeps over the non-zero coefficients until they rest, then over all."""
    b, d = beta.copy(), np.diag(s.cross)
    r = s.with_y - s.cross @ b
    every = np.flatnonzero(s.live)
    todo = every
    for _ in range(most):
        moved = 0.0
        for j in todo:
            z = r[j] + d[j] * b[j]
            new = math.copysign(max(abs(z) - l1, 0.0), z) / (d[j] + l2)
            if (step := new - b[j]) != 0.0:
                r -= s.cross[:, j] * step
                b[j] = new
                moved = max(moved, abs(step) * math.sqrt(d[j]))
        if moved < tol:
            if todo is every:
                return b
            todo = every
        else:
            todo = np.flatnonzero(b)
    return b


def elastic_net_path(g: np.ndarray, alpha: float = 1.0, n_lambda: int = 100, min_ratio: float | None = None, lambdas: np.ndarray | None = None, standardize: bool = True, intercept: bool = True, tol: float = 1e-7, most: int = 100_000) -> Path:
    """Minimisers of |y - a - Xb|^2 / (2n) + lambda (alpha |b|_1 + (1 - alpha) |b|^2 / 2) from cross products of [X, 1, y].

    A grid of its own runs down from the least lambda without coefficients (for alpha = 0: that of 0.001) and ends
    where the explained share of deviance passes 0.999 or grows by less than 1e-5 of itself.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between 0 and 1")
    s = _Scaled(g, standardize, intercept)
    own = lambdas is None
    if own:
        top = np.abs(s.with_y).max(initial=0) / max(alpha, 1e-3) * s.y_scale
        low = min_ratio if min_ratio is not None else (1e-4 if s.n > s.p else 1e-2)
        lambdas = np.geomspace(top, top * low, n_lambda) if top > 0 else np.zeros(1)
    values, vectors = np.linalg.eigh(s.cross) if alpha == 0 else (None, None)
    b, rows, dev = np.zeros(s.p), [], []
    for lam in lambdas / s.y_scale:
        if alpha == 0:
            b = np.where(s.live, vectors @ ((vectors.T @ s.with_y) / np.maximum(values + lam, 1e-300)), 0.0)
        else:
            b = _descend(s, b, lam * alpha, lam * (1 - alpha), tol, most)
        rows.append(b.copy())
        dev.append(float(2 * b @ s.with_y - b @ s.cross @ b))
        if own and len(dev) > 1 and (dev[-1] > 0.999 or dev[-1] - dev[-2] < 1e-5 * dev[-1]):
            break
    beta = np.array(rows) * (s.y_scale / s.scale)
    return Path(np.asarray(lambdas)[: len(rows)], beta, s.y_mean - beta @ s.mean, np.array(dev))


def elastic_net(x: DataFrame, y: str, alpha: float = 1.0, **options) -> Path:
    return elastic_net_path(fold_products(x, y, 1)[0], alpha, **options)


def predict(x: DataFrame, path: Path, k: int) -> DataFrame:
    """(row_id, prediction) at the k-th lambda."""
    terms = F.zip_with("features", F.array(*[F.lit(float(b)) for b in path.beta[k]]), lambda v, b: v * b)
    return x.select("row_id", (F.aggregate(terms, F.lit(float(path.intercept[k])), lambda s, v: s + v)).alias("prediction"))


def _errors(g: np.ndarray, path: Path) -> np.ndarray:
    """Mean squared errors of a path on a fold."""
    v = np.column_stack([-path.beta, -path.intercept, np.ones(len(path.beta))])
    return np.einsum("ki,ij,kj->k", v, g, v) / g[-2, -2]


def _validated(lambdas: np.ndarray, errors: np.ndarray) -> Validated:
    """The lambda of least mean error, and the largest one within a standard error of it."""
    error, se = errors.mean(0), errors.std(0, ddof=1) / math.sqrt(len(errors))
    k = int(error.argmin())
    fits = lambdas[error <= error[k] + se[k]]
    return Validated(lambdas, error, se, float(lambdas[k]), float(fits.max()))


def _split(x: DataFrame, y: str, folds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    if folds < 2:
        raise ValueError("at least two folds are needed")
    g = fold_products(x, y, folds, seed)
    used = g[g[:, -2, -2] > 0]
    if len(used) < 2:
        raise ValueError("fewer than two folds have rows")
    return g.sum(0), used


def elastic_net_cv(x: DataFrame, y: str, alpha: float = 0.0, folds: int = 10, n_lambda: int = 100, seed: int = 0) -> Validated:
    """Cross-validation over the grid of the full data."""
    total, parts = _split(x, y, folds, seed)
    lambdas = elastic_net_path(total, alpha, n_lambda).lambdas
    return _validated(lambdas, np.array([_errors(g, elastic_net_path(total - g, alpha, lambdas=lambdas)) for g in parts]))


def ridge_cv(x: DataFrame, y: str, folds: int = 10, n_lambda: int = 1000, ratio: float = 1000.0, seed: int = 0) -> Validated:
    """Cross-validated ridge |y - Xb|^2 + lambda |b|^2 over columns of unit length, on an ascending grid up to the
    largest cross product with y."""
    total, parts = _split(x, y, folds, seed)

    def unit(g: np.ndarray) -> tuple[_Scaled, np.ndarray, np.ndarray]:
        s = _Scaled(g)
        return s, s.cross, s.with_y * s.y_scale * math.sqrt(s.n)

    s, _, c = unit(total)
    top = np.abs(c).max(initial=0)
    if top <= 0:
        raise ValueError("the response has no correlation with any column")
    lambdas = np.geomspace(top / ratio, top, n_lambda)
    errors = []
    for g in parts:
        s, a, c = unit(total - g)
        values, vectors = np.linalg.eigh(a)
        b = ((vectors.T @ c) / (values + lambdas[:, None])) @ vectors.T / (s.scale * math.sqrt(s.n))
        errors.append(_errors(g, Path(lambdas, b, s.y_mean - b @ s.mean, np.zeros(0))))
    return _validated(lambdas, np.array(errors))


def informed_cv(x: DataFrame, y: str, penalty: np.ndarray, folds: int = 10, n_lambda2: int = 25, ratio: float = 1e4, n_lambda1: int = 50, seed: int = 0) -> Validated:
    """Cross-validation of lambda2 in |y - Xb|^2 / 2 + lambda1 |b|_1 + lambda2 b'Kb / 2 over unit-length columns: for
    each lambda2 the best lambda1 of a grid counts.  K is p x p (groups: the projection on their means)."""
    total, parts = _split(x, y, folds, seed)
    whole = _Scaled(total)
    top = np.abs(whole.with_y).max(initial=0)
    lambda2 = np.geomspace(1.0, 1.0 / ratio, n_lambda2) * max(np.linalg.norm(whole.cross, 2), 1e-12)
    lambda1 = np.geomspace(top, top * 1e-3, n_lambda1)
    errors = np.zeros((len(parts), n_lambda2, n_lambda1))
    for f, g in enumerate(parts):
        s = _Scaled(total - g)
        plain = s.cross
        for i, l2 in enumerate(lambda2):
            s.cross = plain + l2 * penalty
            b, rows = np.zeros(s.p), []
            for l1 in lambda1:
                b = _descend(s, b, l1, 0.0, 1e-5, 200)
                rows.append(b)
            beta = np.array(rows) * (s.y_scale / s.scale)
            errors[f, i] = _errors(g, Path(lambda1, beta, s.y_mean - beta @ s.mean, np.zeros(0)))
    best = errors.mean(0).argmin(1)
    return _validated(lambda2, errors[:, np.arange(n_lambda2), best])


def tikhonov_cv(x: DataFrame, y: str, penalty: np.ndarray, folds: int = 10, n_lambda: int = 100, ratio: float = 1e4, seed: int = 0) -> tuple[Validated, bool]:
    """The same without lambda1, in closed form, and whether the part that K leaves free can fit a training fold."""
    total, parts = _split(x, y, folds, seed)
    lambdas = np.geomspace(1.0, 1.0 / ratio, n_lambda) * max(np.linalg.norm(_Scaled(total).cross, 2), 1e-12)
    free = len(penalty) - np.linalg.matrix_rank(penalty)
    errors = []
    for g in parts:
        s = _Scaled(total - g)
        b = np.array([np.linalg.lstsq(s.cross + lam * penalty, s.with_y, rcond=None)[0] for lam in lambdas]) * (s.y_scale / s.scale)
        errors.append(_errors(g, Path(lambdas, b, s.y_mean - b @ s.mean, np.zeros(0))))
    return _validated(lambdas, np.array(errors)), bool(free >= min((total - g)[-2, -2] for g in parts))
