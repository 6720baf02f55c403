"""Design matrices on shared storage: written once, opened by name, read by ranges of rows and columns.

A stored matrix is Parquet sorted by row_id inside files, so a range of rows is pushed to the scan.  It is never changed
in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import check


def save_matrix(x: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write x (row_id, features, further columns); fails if the path has data."""
    parted = x.repartitionByRange(partitions, "row_id") if partitions else x.repartitionByRange("row_id")
    parted.sortWithinPartitions("row_id").write.mode("errorifexists").parquet(path)


def open_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def view(x: DataFrame, rows: tuple[int, int] | None = None, columns: tuple[int, int] | list[int] | None = None) -> DataFrame:
    """Rows with row_id in [from, to), and columns [from, to) or those listed, in that order."""
    if rows is not None:
        x = x.filter((F.col("row_id") >= rows[0]) & (F.col("row_id") < rows[1]))
    if isinstance(columns, tuple):
        return x.withColumn("features", F.slice("features", columns[0] + 1, max(columns[1] - columns[0], 0)))
    if columns is not None:
        return x.withColumn("features", F.array(*[F.col("features")[j] for j in columns]) if columns else F.expr("cast(array() as array<double>)"))
    return x


def shape(x: DataFrame) -> tuple[int, int]:
    return x.count(), check(x)
