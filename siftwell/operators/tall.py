"""Tall designs that stay on the executors.

Solvers read rows by products only, so a design [X D] is as good as any matrix with its products.  Rows are put in the
order of row_id once, in chunks within the blocks by which dummies are drawn, and kept on the executors' disks.  X and
the responses become the triangle of their QR decomposition.  The dummies of each experiment are drawn block by block and
only their products are kept, from which come their parts within and beyond the columns of that triangle.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dummies import BLOCK, dummies

EPS = float(np.finfo(float).eps)
PART_BYTES, PRODUCT_BYTES = 128 << 20, 256 << 20


def _binary(values: list) -> pa.Array:
    return pa.array([np.ascontiguousarray(v, float).tobytes() for v in values], pa.binary())


def _bucket(cuts: list[int], row_id: Column) -> Column:
    """How many of the ascending cuts are below row_id, as a search tree; null comes last."""
    if not cuts:
        return F.lit(0)

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(row_id <= F.lit(cuts[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(cuts))


def _chunked(x: DataFrame, columns: list[str], n: int, width: int) -> DataFrame:
    """(block, first, rows) in the order of row_id: rows are consecutive ones of a block of dummies, from place `first` on."""
    spark = x.sparkSession
    parts = max(min(-(-n // BLOCK), 2 * spark.sparkContext.defaultParallelism), -(-n * width * 8 // PART_BYTES))
    cuts = x.agg(F.percentile_approx("row_id", [k / parts for k in range(1, parts)], 10000)).first()[0] if parts > 1 else None
    bucket = _bucket(sorted(set(cuts or [])), F.col("row_id")).alias("part")
    counts = {r["part"]: r["count"] for r in x.groupBy(bucket).count().collect()}  # one row for each part
    begin = {k: sum(c for j, c in counts.items() if j < k) for k in counts}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, of, held = 0, None, []

        def out() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([(at - len(rows)) // BLOCK], pa.int64()), pa.array([(at - len(rows)) % BLOCK], pa.int32()), _binary([rows])], names=["block", "first", "rows"])

        for b in batches:
            part = b.column(0).to_numpy()
            m = np.array(b.column(1).flatten(), float).reshape(b.num_rows, width)
            low = 0
            while low < len(m):
                if part[low] != of:
                    if held:
                        yield from out()
                    of, at = part[low], begin[int(part[low])]
                high = min(low + BLOCK - at % BLOCK, low + int(np.searchsorted(part[low:], of, "right")))
                held.append(m[low:high])
                at, low = at + high - low, high
                if at % BLOCK == 0:
                    yield from out()
        if held:
            yield from out()

    values = F.concat("features", F.array(*[F.col(y).cast("double") for y in columns])) if columns else F.col("features")
    placed = x.select(bucket, F.col("row_id"), values.alias("v")).repartitionById(max(len(counts), max(counts) + 1), "part")
    ordered = placed.sortWithinPartitions("part", F.asc_nulls_last("row_id"), "v").select("part", "v")
    return ordered.mapInArrow(pack, "block bigint, first int, rows binary")


def _folded(chunks: DataFrame, start: np.ndarray, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[np.ndarray]:
    """What `step` makes of a task's chunks, one array for each task that has any; the driver sees one at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start
        for b in batches:
            for rows in b.column(0):
                state = step(state, np.frombuffer(rows.as_buffer()))
        if state is not start:
            yield pa.RecordBatch.from_arrays([pa.array([state.shape[-1]], pa.int32()), _binary([state])], names=["width", "state"])

    states = chunks.select("rows").mapInArrow(run, "width int, state binary").persist(StorageLevel.DISK_ONLY)
    states.count()
    for r in states.toLocalIterator():
        yield np.frombuffer(r["state"]).reshape(-1, r["width"])
    states.unpersist()


def _settled(r: np.ndarray, p: int) -> np.ndarray:
    """Of the first p columns those that are equal but for rounding, or but for the sign, become so to the last bit."""
    norm = np.linalg.norm(r[:, :p], axis=0)
    corr = (r[:, :p].T @ r[:, :p]) / np.maximum(np.outer(norm, norm), EPS)
    for j in range(p):
        for k in np.flatnonzero(np.abs(corr[j, :j]) > 1 - 1e-9).tolist():
            sign = np.sign(corr[j, k])
            if np.linalg.norm(r[:, j] - sign * r[:, k]) <= 1e-13 * norm[k]:
                r[:, j] = sign * r[:, k]
                break
    return r


@dataclasses.dataclass
class Tall:
    """A standardized design of `shape`: rows of `triangle` [p + q, p] have its products, and with `ends` [p + q, q] those
    with the centered responses.  `free` lets go of what is kept on the executors."""

    chunks: DataFrame
    shape: tuple[int, int]
    mean: np.ndarray
    inverse: np.ndarray
    triangle: np.ndarray
    ends: np.ndarray
    kept: tuple | None = None

    @property
    def raw(self) -> np.ndarray:
        """The triangle of the centered columns as they were."""
        scale = np.linalg.norm(self.triangle, axis=0) * self.inverse[: self.shape[1]]
        return self.triangle / np.where(scale > 0, scale, 1)

    def lag(self) -> float:
        """The mean over rows of the lag-1 ratio along standardized columns."""
        p, mean, inverse, times = self.shape[1], self.mean, self.inverse, np.linalg.norm(self.triangle, axis=0).max()

        def step(state, rows):
            m = (rows.reshape(-1, len(mean))[:, :p] - mean[:p]) * inverse[:p] * times
            return state + ((m[:, 1:] * m[:, :-1]).sum(1) / np.maximum((m * m).sum(1), EPS)).sum()

        return float(sum(s[0, 0] for s in _folded(self.chunks, np.zeros((1, 1)), step)) / self.shape[0])

    def free(self) -> None:
        for frame in (self.chunks, *(self.kept[1] if self.kept else [])):
            frame.unpersist()
        self.kept = None

    def drawn(self, c, layers: int) -> DataFrame:
        """(k, d): for each experiment the dummies as columns of p + q + layers * p rows, below and beside the triangle.
        The frame of the last call is kept."""
        key = (layers, c.k, c.seed, c.strategy, c.distribution, c.scaling, id(c.options.get("factors")))
        if self.kept and self.kept[0] == key:
            return self.kept[1][0]
        if self.kept:
            for frame in self.kept[1]:
                frame.unpersist()
        width = layers * self.shape[1]
        at_once = max(1, PRODUCT_BYTES // (width * (width + len(self.mean) + 1) * 8))
        frames = [self._dummies(c, layers, list(range(k, min(k + at_once, c.k)))).persist(StorageLevel.DISK_ONLY) for k in range(0, c.k, at_once)]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        self.kept = (key, [out, *frames])
        return out

    def _dummies(self, c, layers: int, ks: list[int]) -> DataFrame:
        n, p = self.shape
        mean, inverse, width, wide = self.mean, self.inverse, layers * p, len(self.mean)
        seed, strategy, distribution, scaling, factors = c.seed, c.strategy, c.distribution, c.scaling, c.options.get("factors")
        both = np.hstack([self.triangle, self.ends])
        back = np.linalg.pinv(both / np.maximum(np.linalg.norm(both, axis=0), 1e-300), rcond=1e-10).T
        upper = np.triu_indices(width)

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, least = {}, None
            for b in batches:
                for block, first, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    m = (np.frombuffer(rows.as_buffer()).reshape(-1, wide) - mean) * inverse
                    m = np.column_stack([np.ones(len(m)), m])
                    least = block * BLOCK + first if least is None else least
                    for k in ks:
                        d = dummies(n, p, layers, k, seed, strategy, distribution, factors, block)[first : first + len(m)]
                        if k not in sums:
                            sums[k] = [np.zeros((wide + 1, width)), np.zeros((width, width))]
                        sums[k][0] += m.T @ d
                        sums[k][1] += d.T @ d
            for k, (across, own) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([least], pa.int64()), _binary([across]), _binary([own[upper]])], names=["k", "least", "across", "own"])

        def placed(k: int, across: np.ndarray, packed: np.ndarray) -> tuple[int, bytes]:
            own = np.zeros((width, width))
            own[upper] = packed
            own = own + np.triu(own, 1).T - np.outer(across[0], across[0]) / n
            norm = np.sqrt(np.maximum(np.diag(own), 0))
            unit = np.where(norm < EPS, 1.0, norm)
            within = back @ (across[1:] / unit)
            value, vector = np.linalg.eigh(own / np.outer(unit, unit) - within.T @ within)
            d = np.vstack([within, np.sqrt(np.maximum(value, 0))[:, None] * vector.T])
            d *= unit if factors is not None else np.where(norm < EPS, 0.0, 1.0 if scaling == "l2" else np.sqrt(n - 1))
            return k, d.tobytes()

        def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            k, across, packed = None, None, None
            for f in frames:
                for r in f.itertuples(index=False):
                    a, o = np.frombuffer(r.across).reshape(wide + 1, width), np.frombuffer(r.own)
                    if r.k != k:
                        if k is not None:
                            yield pd.DataFrame([placed(k, across, packed)], columns=["k", "d"])
                        k, across, packed = r.k, a.copy(), o.copy()
                    else:
                        across += a
                        packed += o
            if k is not None:
                yield pd.DataFrame([placed(k, across, packed)], columns=["k", "d"])

        parts = self.chunks.mapInArrow(products, "k int, least bigint, across binary, own binary")
        return parts.repartitionById(len(ks), F.col("k") - ks[0]).sortWithinPartitions("k", "least").mapInPandas(added, "k int, d binary")


def tall(x: DataFrame, columns: list[str], n: int, p: int, scaling: str = "l2") -> Tall:
    """The standardized design of x with the responses in `columns`, which are finite."""
    wide = p + len(columns)
    chunks = _chunked(x, columns, n, wide).persist(StorageLevel.DISK_ONLY)
    mean = sum(s[0] for s in _folded(chunks, np.zeros((1, wide)), lambda s, rows: s + rows.reshape(-1, wide).sum(0))) / n

    def step(r, rows):
        return np.linalg.qr(np.vstack([r, rows.reshape(-1, wide) - mean]), mode="r")

    r = np.zeros((0, wide))
    for one in _folded(chunks, np.zeros((0, wide)), step):
        r = np.linalg.qr(np.vstack([r, one]), mode="r")
    r = np.vstack([r, np.zeros((wide - len(r), wide))])
    norm = np.linalg.norm(r, axis=0)
    flat = norm <= np.maximum(EPS, 1e-13 * np.sqrt(n) * np.abs(mean))  # what rounding leaves of a constant
    inverse = np.where(flat, 0.0, 1 / np.where(flat, 1.0, norm))
    triangle = _settled(r[:, :p] * inverse[:p] * (1 if scaling == "l2" else np.sqrt(n - 1)), p)
    return Tall(chunks, (n, p), mean, inverse, triangle, np.where(flat[p:], 0.0, r[:, p:]))
