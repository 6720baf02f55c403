"""Ridge regression, singular values, principal components and synthetic designs.

Each fit is one Gram aggregation (at most MAX_GRAM columns, so what reaches the driver is bounded by columns, not rows);
transforms are per-row tasks.  Singular values come from the eigenvalues of the Gram matrix, so those below about 1e-8 of
the largest are noise.

Defined cases: null, NaN or infinite values and rows of unequal length are refused by `matrix.check`, as is an empty
table; more columns than rows are allowed (the solution of least norm where lam is 0); equal or constant columns give
zero singular values, whose left vectors are zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import EPS, check, gram

PREDICTORS = ("normal", "student_t", "ar1", "gumbel")
NOISE = ("normal", "student_t", "ar1", "normal_mixture", "student_t_mixture")


def _dense(g: DataFrame, p: int) -> np.ndarray:
    t = g.toArrow()
    out = np.zeros((p, p))
    out[np.array(t.column("i")), np.array(t.column("j"))] = np.array(t.column("g"))
    return out


def ridge(rows: DataFrame, y: str, lam: float) -> np.ndarray:
    """Coefficients that minimise |y - X b|^2 + lam |b|^2; nothing is centered."""
    if lam < 0:
        raise ValueError("lam must not be negative")
    p = check(rows)
    g = _dense(gram(rows, y), p + 1)
    a, b = g[:p, :p] + lam * np.eye(p), g[:p, p]
    try:
        low = np.linalg.cholesky(a)
        return np.linalg.solve(low.T, np.linalg.solve(low, b))
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


class Components(NamedTuple):
    """What a decomposition of p columns keeps: loadings are [p, m], `sd` the singular values."""

    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray
    sd: np.ndarray
    n: int

    @property
    def explained(self) -> np.ndarray:
        return self.sd**2 / (self.n - 1)


def components(rows: DataFrame, m: int, center: bool = True, normalize: bool = False) -> Components:
    """The first m components; normalize scales centered columns to length 1.  Each one's largest loading is positive."""
    p = check(rows)
    # A column of ones brings the sums and the number of rows into the same pass.
    g = _dense(gram(rows.withColumn("features", F.concat("features", F.array(F.lit(1.0))))), p + 1)
    n, sums = int(round(g[p, p])), g[:p, p]
    mean = sums / n if center else np.zeros(p)
    cross = g[:p, :p] - (n * np.outer(mean, mean) if center else 0.0)
    scale = np.ones(p)
    if normalize:
        norm = np.sqrt(np.maximum(np.diag(cross), 0.0))
        scale = np.where(norm < EPS, 1.0, norm)
        cross = cross / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(cross)
    first = np.argsort(-values, kind="stable")[: min(m, p, n)]
    v = vectors[:, first]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return Components(mean, scale, v, np.sqrt(np.maximum(values[first], 0.0)), n)


def _mapped(rows: DataFrame, column: str, f) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = f(np.array(b.column(1).flatten(), float).reshape(b.num_rows, -1))
                at = np.arange(0, out.size + 1, max(out.shape[1], 1), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(out.ravel()))], names=["row_id", column])

    return rows.select("row_id", "features").mapInArrow(each, f"row_id bigint, {column} array<double>")


def scores(rows: DataFrame, c: Components) -> DataFrame:
    """(row_id, scores): U S of the decomposition."""
    mean, scale, loadings = c.mean, c.scale, c.loadings
    return _mapped(rows, "scores", lambda x: (x - mean) / scale @ loadings)


def left_vectors(rows: DataFrame, c: Components) -> DataFrame:
    """(row_id, u): left singular vectors."""
    mean, scale, loadings, sd = c.mean, c.scale, c.loadings, c.sd
    inverse = np.where(sd > 1e-8 * max(sd.max(), EPS), 1 / np.where(sd > 0, sd, 1.0), 0.0)
    return _mapped(rows, "u", lambda x: (x - mean) / scale @ loadings * inverse)


def restored(scored: DataFrame, c: Components) -> DataFrame:
    """(row_id, features) from (row_id, scores)."""
    mean, scale, loadings = c.mean, c.scale, c.loadings
    return _mapped(scored.select("row_id", F.col("scores").alias("features")), "features", lambda z: z @ loadings.T * scale + mean)


def synthetic(spark: SparkSession, n: int, beta: dict[int, float], p: int, snr: float, seed: int, predictors: str = "normal", noise: str = "normal", df: float = 3.0, rho: float = 0.5, outliers: float = 0.1, spread: float = 5.0) -> DataFrame:
    """(row_id, features, y): random columns, a sparse signal, and noise at a ratio of variances.

    Every draw is keyed by seed and row, so a lost task makes the same rows again.  Predictors are normal, student_t,
    gumbel, or ar1 along the columns; noise is normal, student_t, ar1 along the rows, or a mixture in which a share
    `outliers` of the rows has `spread` times the sd.  The noise has the variance of the signal over snr; the
    denominator of that variance is n - 1 up to 100 rows and n beyond.
    """
    if predictors not in PREDICTORS or noise not in NOISE:
        raise ValueError("unknown distribution")
    if snr <= 0 or n < 1 or any(not 0 <= k < p for k in beta) or (noise.startswith("student_t") and df <= 2) or not -1 < rho < 1:
        raise ValueError("snr and n must be positive, the support inside the columns, and the noise of finite variance")
    at, coef = np.array(sorted(beta), int), np.array([beta[k] for k in sorted(beta)])

    back = math.ceil(math.log(1e-9) / math.log(abs(rho))) if noise == "ar1" and rho else 0  # what older draws add is below 1e-9
    fade = rho ** np.arange(back + 1) * math.sqrt(1 - rho * rho)
    mixed = math.sqrt(1 - outliers + outliers * spread * spread)

    def noise_of(r: np.random.Generator, row: int) -> float:
        if noise == "ar1":
            return float(fade @ [np.random.default_rng([seed, 1, row - k + back]).standard_normal() for k in range(back + 1)])
        e = r.standard_t(df) / np.sqrt(df / (df - 2)) if noise.startswith("student_t") else r.standard_normal()
        return e * (spread if r.random() < outliers else 1.0) / mixed if noise.endswith("mixture") else e

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            x, signal, e = np.empty((len(ids), p)), np.empty(len(ids)), np.empty(len(ids))
            for k, row in enumerate(ids):
                r = np.random.default_rng([seed, row])
                x[k] = r.standard_t(df, p) if predictors == "student_t" else r.gumbel(size=p) if predictors == "gumbel" else r.standard_normal(p)
                if predictors == "ar1":
                    for j in range(1, p):
                        x[k, j] = rho * x[k, j - 1] + np.sqrt(1 - rho * rho) * x[k, j]
                signal[k] = x[k, at] @ coef
                e[k] = noise_of(r, row)
            offsets = np.arange(0, x.size + 1, p, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel())), pa.array(signal), pa.array(e)], names=["row_id", "features", "signal", "e"])

    rows = spark.range(n).withColumnRenamed("id", "row_id").mapInArrow(draw, "row_id bigint, features array<double>, signal double, e double")
    var = rows.agg(F.var_samp("signal") if 1 < n <= 100 else F.var_pop("signal")).first()[0]
    sd = float(np.sqrt((var or 0.0) / snr))
    return rows.select("row_id", "features", (F.col("signal") + sd * F.col("e")).alias("y"))
