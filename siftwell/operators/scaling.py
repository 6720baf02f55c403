"""Fitted scalers of columns: one aggregation to fit, row expressions to apply, a small table to save.

kinds: zscore (sd with n - 1; without centering the root mean square with n - 1), l1 and l2 (length of the column,
centered or not).  A column whose scale is below the threshold gets the scale 1 and is listed as dropped.

Defined cases: fewer than two rows are refused for zscore; values must be finite (`matrix.check`).
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import EPS, check


def _literal(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


@dataclasses.dataclass
class Scaler:
    kind: str
    center: np.ndarray
    scale: np.ndarray
    dropped: list[int]

    def transform(self, x: DataFrame) -> DataFrame:
        z = F.zip_with(F.zip_with("features", _literal(self.center), lambda v, m: v - m), _literal(self.scale), lambda v, s: v / s)
        return x.withColumn("features", z)

    def inverse(self, x: DataFrame) -> DataFrame:
        z = F.zip_with(F.zip_with("features", _literal(self.scale), lambda v, s: v * s), _literal(self.center), lambda v, m: v + m)
        return x.withColumn("features", z)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(self.kind, j, float(c), float(s), j in set(self.dropped)) for j, (c, s) in enumerate(zip(self.center, self.scale, strict=True))]
        spark.createDataFrame(rows, "kind string, col_id int, center double, scale double, dropped boolean").coalesce(1).write.mode("errorifexists").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, kind: str | None = None) -> Scaler:
        rows = spark.read.parquet(path).orderBy("col_id").collect()  # p rows
        if kind is not None and any(r["kind"] != kind for r in rows):
            raise ValueError(f"not a {kind} scaler")
        return Scaler(rows[0]["kind"], np.array([r["center"] for r in rows]), np.array([r["scale"] for r in rows]), [r["col_id"] for r in rows if r["dropped"]])


def fit(x: DataFrame, kind: str = "l2", center: bool = True, threshold: float = EPS) -> Scaler:
    """A scaler of the columns of x."""
    if kind not in ("zscore", "l1", "l2"):
        raise ValueError(f"unknown scaler {kind}")
    p = check(x)
    long = x.select(F.posexplode("features").alias("col_id", "value"))
    m = long.groupBy("col_id").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.sum(F.col("value") ** 2).alias("sq"), F.var_samp("value").alias("var"), F.sum(F.abs("value")).alias("abs"))
    rows = m.collect()  # p rows
    n = rows[0]["n"]
    if kind == "zscore" and n < 2:
        raise ValueError("at least two rows are needed")
    mean, size = np.zeros(p), np.zeros(p)
    for r in rows:
        mean[r["col_id"]] = r["mean"] if center else 0.0
        around = (r["var"] or 0.0) * (n - 1) if center else r["sq"]
        size[r["col_id"]] = (around / (n - 1)) ** 0.5 if kind == "zscore" else around**0.5 if kind == "l2" else r["abs"]
    if kind == "l1" and center:
        away = long.select("col_id", F.abs(F.col("value") - F.element_at(_literal(mean), F.col("col_id") + 1)).alias("d")).groupBy("col_id").agg(F.sum("d").alias("d"))
        for r in away.collect():  # p rows
            size[r["col_id"]] = r["d"]
    low = size < threshold
    return Scaler(kind, mean, np.where(low, 1.0, size), np.flatnonzero(low).tolist())


def center_y(x: DataFrame, y: str) -> tuple[DataFrame, float]:
    """x with its response centered, and the mean."""
    mean = float(x.agg(F.avg(y)).first()[0] or 0.0)
    return x.withColumn(y, F.col(y) - mean), mean


def decenter_y(x: DataFrame, y: str, mean: float) -> DataFrame:
    return x.withColumn(y, F.col(y) + mean)
