"""Design matrices.

A matrix is a DataFrame of rows (row_id, features array<double>); the long form is (row_id, col_id, value).  Moments of
columns are one aggregation; Gram blocks are summed per task (p x p for each, p is bounded by MAX_GRAM) before they
shuffle, so a tall matrix costs one pass and a shuffle of p x p values per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_GRAM, EPS = 4000, float(np.finfo(float).eps)


def rows_of(df: DataFrame, row_id: str, features: str) -> DataFrame:
    return df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(features).cast("array<double>").alias("features"))


def assemble(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """Numeric columns of a table as a matrix; col_id is the place in `columns`."""
    return df.select(F.col(row_id).cast("bigint").alias("row_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))


def to_long(x: DataFrame) -> DataFrame:
    return x.select("row_id", F.posexplode("features").alias("col_id", "value"))


def check(x: DataFrame) -> int:
    """The number of columns; raises if a value is null, NaN or infinite, or if rows differ in length."""
    bad = F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    r = x.agg(F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi"), F.max((F.col("features").isNull() | bad).cast("int")).alias("bad"), F.count("*").alias("n")).first()
    if not r["n"] or r["bad"] or r["lo"] != r["hi"]:
        raise ValueError("a design matrix needs rows of equal length with finite values")
    return r["hi"]


def moments(long: DataFrame) -> DataFrame:
    """(col_id, n, mean, sd, l2, l1): the last two are norms of the centered column."""
    m = long.groupBy("col_id").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    l1 = long.join(m.select("col_id", "mean"), "col_id").groupBy("col_id").agg(F.sum(F.abs(F.col("value") - F.col("mean"))).alias("l1"))
    return m.join(l1, "col_id").select("col_id", "n", "mean", F.sqrt("var").alias("sd"), F.sqrt(F.col("var") * (F.col("n") - 1)).alias("l2"), "l1")



def scaled(long: DataFrame, how: str = "l2") -> DataFrame:
    """Centered columns over their l2 norm, l1 norm or sd (zscore); a degenerate scale is 1."""
    scale = F.col({"l2": "l2", "l1": "l1", "zscore": "sd"}[how])
    m = moments(long).select("col_id", "mean", F.when(scale < EPS, 1.0).otherwise(scale).alias("scale"))
    return long.join(m, "col_id").select("row_id", "col_id", ((F.col("value") - F.col("mean")) / F.col("scale")).alias("value"))


def unscaled(long: DataFrame, stats: DataFrame) -> DataFrame:
    """The inverse, with stats (col_id, mean, scale)."""
    return long.join(stats, "col_id").select("row_id", "col_id", (F.col("value") * F.col("scale") + F.col("mean")).alias("value"))


def gram(x: DataFrame, with_y: str | None = None) -> DataFrame:
    """(i, j, g) of the raw cross products; with_y names a further column that becomes index p."""
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            m = np.array(b.column(0).flatten(), float).reshape(b.num_rows, -1)
            if with_y:
                m = np.column_stack([m, np.array(b.column(1), float)])
            if m.shape[1] > MAX_GRAM:
                raise ValueError(f"a Gram matrix is for at most {MAX_GRAM} columns")
            total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            i, j = np.indices(total.shape, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "g"])

    parts = x.select("features", *([F.col(with_y).cast("double")] if with_y else [])).mapInArrow(block, "i int, j int, g double")
    return parts.groupBy("i", "j").agg(F.sum("g").alias("g"))


def column_pairs(g: DataFrame) -> DataFrame:
    """(i, j, gij, gii, gjj) for i < j."""
    d = g.filter("i = j")
    a, b = d.select("i", F.col("g").alias("gii")), d.select("j", F.col("g").alias("gjj"))
    return g.filter("i < j").withColumnRenamed("g", "gij").join(a, "i").join(b, "j")


def distances(x: DataFrame, how: str) -> DataFrame:
    """(i, j, d) for columns i < j: sq_euclidean, correlation (1 - |corr|) or manhattan."""
    if how == "sq_euclidean":
        return column_pairs(gram(x)).select("i", "j", (F.col("gii") + F.col("gjj") - 2 * F.col("gij")).alias("d"))
    if how == "correlation":
        # Centered through the sums: a constant column appended to the matrix gives them.
        g = gram(x.withColumn("features", F.concat("features", F.array(F.lit(1.0)))))
        p = g.agg(F.max("i")).first()[0]
        s = g.filter(f"j = {p} and i < {p}").select(F.col("i").alias("k"), F.col("g").alias("s"))
        n = g.filter(f"i = {p} and j = {p}").first()["g"]
        c = g.filter(f"i < {p} and j < {p}").join(s.withColumnsRenamed({"k": "i", "s": "si"}), "i").join(s.withColumnsRenamed({"k": "j", "s": "sj"}), "j")
        c = c.select("i", "j", (F.col("g") - F.col("si") * F.col("sj") / n).alias("g"))
        return column_pairs(c).select("i", "j", (1 - F.abs(F.col("gij") / F.sqrt(F.col("gii") * F.col("gjj")))).alias("d"))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = np.array(b.column(0).flatten(), float).reshape(b.num_rows, -1)
                part = np.array([np.abs(m - m[:, [k]]).sum(0) for k in range(m.shape[1])])
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total), 1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "d"])

    return x.select("features").mapInArrow(block, "i int, j int, d double").groupBy("i", "j").agg(F.sum("d").alias("d"))


def equi_rho(x: DataFrame) -> DataFrame:
    """(rho): the mean correlation of column pairs."""
    return _correlations(x).agg(F.avg("r").alias("rho"))


def block_equi_rho(x: DataFrame, size: int) -> DataFrame:
    """(block, rho) of contiguous blocks of `size` columns."""
    r = _correlations(x).filter(f"i div {size} = j div {size}")
    return r.groupBy(F.expr(f"i div {size}").alias("block")).agg(F.avg("r").alias("rho"))


def _correlations(x: DataFrame) -> DataFrame:
    long = to_long(x)
    z = scaled(long, "l2")
    wide = z.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_id", "value"))), lambda v: v["value"]).alias("features"))
    return gram(wide).filter("i < j").select("i", "j", F.col("g").alias("r"))


def ar1_rho(x: DataFrame) -> DataFrame:
    """(rho): the absolute mean over rows of the lag-1 ratio along centered, scaled columns."""
    z = scaled(to_long(x), "l2")
    before = F.lag("value").over(Window.partitionBy("row_id").orderBy("col_id"))
    pairs = z.withColumn("before", before)
    rows = pairs.groupBy("row_id").agg((F.sum(F.col("value") * F.col("before")) / F.sum(F.col("value") * F.col("value"))).alias("r"))
    return rows.agg(F.abs(F.avg("r")).alias("rho"))
