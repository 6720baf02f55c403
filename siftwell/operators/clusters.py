"""Agglomerative clustering of a design's columns.

Distances are a distributed Gram (or Manhattan) aggregation; the tree is built from the p x p table, whose size doesn't
depend on rows (p is bounded by MAX_GRAM).  A tree is a table of merges (step, cluster1, cluster2, distance, size):
leaves are 0 .. p-1, the merge of step s makes cluster p + s, and cluster1 < cluster2.

Defined cases: one column has an empty tree; ties merge in the order of column ids; constant columns are at correlation
distance 1 from all others.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import check, distances, gram

#: Linkages whose recurrence holds for squared Euclidean distances only.
GEOMETRIC = frozenset({"ward", "centroid", "median"})
LINKAGES = ("single", "complete", "average", "wpgma", "ward", "centroid", "median")


class Merge(NamedTuple):
    step: int
    cluster1: int
    cluster2: int
    distance: float
    size: int


def valid(method: str, metric: str) -> None:
    if method not in LINKAGES:
        raise ValueError(f"unknown linkage {method}")
    if method in GEOMETRIC and metric != "sq_euclidean":
        raise ValueError(f"{method} linkage needs squared Euclidean distances")


def _updated(method: str, da: np.ndarray, db: np.ndarray, dab: float, na: int, nb: int, n: np.ndarray) -> np.ndarray:
    """Distances of the union of clusters a and b to the others, from theirs."""
    if method == "complete":
        return np.maximum(da, db)
    if method == "wpgma":
        return (da + db) / 2
    if method == "median":
        return (da + db) / 2 - dab / 4
    if method == "ward":
        return ((na + n) * da + (nb + n) * db - n * dab) / (na + nb + n)
    mean = (na * da + nb * db) / (na + nb)
    return mean - na * nb * dab / (na + nb) ** 2 if method == "centroid" else mean


def _spanning(d: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges of a minimum spanning tree: what single linkage merges along."""
    p = len(d)
    away, via, out = d[0].copy(), np.zeros(p, int), []
    done = np.zeros(p, bool)
    done[0] = True
    for _ in range(p - 1):
        j = int(np.where(done, np.inf, away).argmin())
        out.append((int(via[j]), j, float(away[j])))
        done[j] = True
        near = d[j] < away
        away[near], via[near] = d[j][near], j
    return out


def _merged(d: np.ndarray, method: str) -> list[tuple[int, int, float]]:
    """Merges as (a member of one cluster, a member of the other, distance); each row keeps its nearest neighbour."""
    d, p = d.astype(float).copy(), len(d)
    np.fill_diagonal(d, np.inf)
    size, open_ = np.ones(p, int), np.ones(p, bool)
    nearest, least = d.argmin(1), d.min(1)
    out = []
    for _ in range(p - 1):
        a = int(np.where(open_, least, np.inf).argmin())
        b = int(nearest[a])
        a, b = min(a, b), max(a, b)
        out.append((a, b, float(d[a, b])))
        rest = open_.copy()
        rest[[a, b]] = False
        row = np.full(p, np.inf)
        row[rest] = _updated(method, d[a, rest], d[b, rest], d[a, b], size[a], size[b], size[rest])
        size[a] += size[b]
        open_[b] = False
        d[b, :] = d[:, b] = np.inf
        d[a, :] = d[:, a] = row
        stale = np.flatnonzero(rest & ((nearest == a) | (nearest == b)))
        nearest[stale], least[stale] = d[stale].argmin(1), d[stale].min(1)
        closer = rest & (row < least)
        nearest[closer], least[closer] = a, row[closer]
        nearest[a], least[a] = row.argmin(), row.min()
    return out


def tree(d: np.ndarray, method: str = "single") -> list[Merge]:
    """The merges of a symmetric distance matrix, by ascending distance."""
    pairs = _spanning(d) if method == "single" else _merged(d, method)
    p = len(d)
    top, size = list(range(2 * p - 1)), [1] * (2 * p - 1)

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for step, (a, b, height) in enumerate(sorted(pairs, key=lambda m: m[2])):
        a, b = sorted((root(a), root(b)))
        top[a] = top[b] = p + step
        size[p + step] = size[a] + size[b]
        out.append(Merge(step, a, b, height, size[p + step]))
    return out


def _labels(merges: list[Merge], p: int) -> np.ndarray:
    """Components under the given merges, numbered by first appearance."""
    top = np.arange(p + (merges[-1].step + 1 if merges else 0))
    for m in merges:
        top[m.cluster1] = top[m.cluster2] = p + m.step
    for x in range(len(top) - 1, -1, -1):
        top[x] = top[top[x]]
    found: dict[int, int] = {}
    return np.array([found.setdefault(int(t), len(found)) for t in top[:p]])


def cut_by_height(merges: list[Merge], p: int, height: float) -> np.ndarray:
    """Labels after all merges at a distance of at most `height`."""
    return _labels([m for m in merges if m.distance <= height], p)


def cut(merges: list[Merge], p: int, k: int) -> np.ndarray:
    """Labels of k clusters."""
    if not 1 <= k <= p:
        raise ValueError("k must lie between 1 and the number of columns")
    return _labels(merges[: p - k], p)


def members(labels: np.ndarray) -> list[np.ndarray]:
    """Column ids of each label."""
    return [np.flatnonzero(labels == g) for g in range(labels.max() + 1)] if len(labels) else []


def square(x: DataFrame, metric: str = "correlation") -> np.ndarray:
    """The p x p distances of the columns."""
    p = check(x)
    t = distances(x, metric).toArrow()
    out = np.zeros((p, p))
    i, j = np.array(t.column("i")), np.array(t.column("j"))
    d = np.array(t.column("d").fill_null(float("nan")), float)
    out[i, j] = out[j, i] = np.where(np.isfinite(d), np.maximum(d, 0), 1.0)
    return out


def cluster(x: DataFrame, method: str = "single", metric: str = "correlation") -> DataFrame:
    """The merges of the columns of x, as a table."""
    valid(method, metric)
    rows = [tuple(m) for m in tree(square(x, metric), method)]
    return x.sparkSession.createDataFrame(rows, "step int, cluster1 int, cluster2 int, distance double, size int")


def simhash(x: DataFrame, bits: int = 64, seed: int = 42) -> DataFrame:
    """(col_id, bits array<boolean>): signs of the columns' sums against random row vectors, drawn by row id."""
    p = check(x)
    long = x.select("row_id", F.posexplode("features").alias("col_id", "value"))
    mean = long.groupBy("col_id").agg(F.avg("value").alias("mean"))
    signs = [F.when(F.xxhash64("row_id", F.lit(seed), F.lit(b)) % 2 == 0, 1.0).otherwise(-1.0) for b in range(bits)]
    drawn = long.join(F.broadcast(mean), "col_id").withColumn("c", F.col("value") - F.col("mean"))
    out = drawn.groupBy("col_id").agg(F.array(*[F.sum(F.col("c") * s) > 0 for s in signs]).alias("bits"))
    return out.filter(F.col("col_id") < p)


def lsh_distances(x: DataFrame, exact_within: int | None = None, bits: int = 64, seed: int = 42) -> DataFrame:
    """(i, j, d): the correlation distance that SimHash bits estimate, or with exact_within the exact one for pairs that
    differ in at most so many bits and 1 for the rest."""
    h = simhash(x, bits, seed)
    a, b = h.select(F.col("col_id").alias("i"), F.col("bits").alias("u")), h.select(F.col("col_id").alias("j"), F.col("bits").alias("v"))
    differ = F.aggregate(F.zip_with("u", "v", lambda s, t: (s != t).cast("int")), F.lit(0), lambda s, t: s + t)
    exact = distances(x, "correlation")
    pairs = exact.join(a, "i").join(b, "j").withColumn("differ", differ)
    near = 1 - F.abs(F.cos(F.lit(np.pi) * F.col("differ") / bits))
    return pairs.select("i", "j", (near if exact_within is None else F.when(F.col("differ") <= exact_within, F.col("d")).otherwise(1.0)).alias("d"))


def cut_sizes(spark: SparkSession, merges: list[Merge], p: int, heights: list[float]) -> DataFrame:
    """(height, group_id, col_id) for each height."""
    rows = [(float(h), int(g), j) for h in heights for j, g in enumerate(cut_by_height(merges, p, h))]
    return spark.createDataFrame(rows, "height double, group_id int, col_id int")


def correlations(x: DataFrame) -> np.ndarray:
    """The p x p correlations of the columns, from one Gram pass; 0 for constant columns."""
    p = check(x)
    t = gram(x.withColumn("features", F.concat("features", F.array(F.lit(1.0))))).toArrow()
    g = np.zeros((p + 1, p + 1))
    g[np.array(t.column("i")), np.array(t.column("j"))] = np.array(t.column("g"))
    c = g[:p, :p] - np.outer(g[:p, p], g[:p, p]) / g[p, p]
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    return np.where(np.outer(sd, sd) > 0, c / np.maximum(np.outer(sd, sd), 1e-300), 0.0)
