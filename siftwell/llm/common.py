"""Pieces shared by the corpus operators: shared-folder tables, Arrow text access and vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import math
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 18

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_A = np.uint64(0xD6E8FEB86659FD93)

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); an own one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            found = tempfile.mkdtemp(prefix="siftwell-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_siftwell"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftwell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the cluster's own cleaning of the folder applies
            return


def fresh(df: DataFrame, prefix: str) -> str:
    """prefix, lengthened until no column of df begins with it (whatever the case): for columns of an operator's own."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


#: Rows (of a few numbers) that are broadcast at most: some 50 MB as a hash table.
MAX_BROADCAST_ROWS = 400_000


def joinable(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, as a side of a join: broadcast up to MAX_BROADCAST_ROWS, shuffled beyond."""
    kept = materialize(df)
    return F.broadcast(kept) if kept.count() <= MAX_BROADCAST_ROWS else kept


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Before Python tasks: send this package to the executors once, and bound the rows of an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        at = tempfile.mkdtemp(prefix="siftwell-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        with zipfile.ZipFile(name := f"{at}/{package.name}.zip", "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(name)  # executors get it from the driver's file server
        _shipped.add(sc.applicationId)


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for so many rows: at least the session's, more as the rows grow."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_task))


def give_back() -> None:
    """At the end of a task: free memory goes back to the machine, since its Python worker stays for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        return


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data, offsets


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powered(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * STEP_BYTES)
        for k, base in enumerate((_P, _P_INV)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            done = 1
            while done < size:
                step = np.uint64(pow(base, done, 1 << 64))
                more = min(done, size - done)
                out[done : done + more] = out[:more] * step
                done += more
            _powers[k] = out
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_SEPARATES = np.zeros(256, bool)
_SEPARATES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased) of consecutive texts.

    Returns 64-bit word hashes, first and end byte of each word (within data), and for each text the index of its
    first word, with the total at the end.
    """
    base = int(offsets[0])
    b = data[base : int(offsets[-1])]
    n = len(b)
    cuts = (offsets - base).astype(np.int64)
    sep = _SEPARATES[b]
    begins = ~sep
    ends = begins.copy()
    if n:
        after_text = np.zeros(n + 1, bool)
        after_text[cuts] = True
        begins[1:] &= sep[:-1] | after_text[1:n]
        ends[:-1] &= sep[1:] | after_text[1:n]
    s = np.flatnonzero(begins)
    e = np.flatnonzero(ends) + 1
    pw, inv = _powered(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[b].astype(np.uint64) + np.uint64(1)) * pw[:n], out=total[1:])
    h = (total[e] - total[s]) * inv[s]
    h = mix64(h + (e - s).astype(np.uint64) * _A)
    return h, s + base, e + base, np.searchsorted(s, cuts)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, text by text, in order (with repeats), and each text's first, total at the end.

    A text with 1 to k-1 words has its whole sequence as one shingle; one without words has none.
    """
    counts = np.diff(first)
    n = len(words)
    each = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(each, out=out_first[1:])
    if not n:
        return np.zeros(0, np.uint64), out_first
    full = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        full = full * _A + words[j : j + len(full)] if len(full) else full
    out = np.empty(out_first[-1], np.uint64)
    valid = np.zeros(n, bool)
    where = np.zeros(n + 1, np.int32)
    long = counts >= k
    np.add.at(where, first[:-1][long], 1)
    np.add.at(where, first[:-1][long] + each[long], -1)
    valid = np.cumsum(where[:n]) > 0
    is_long = np.repeat(long, each)
    out[is_long] = mix64(full[valid[: len(full)]])
    for t in np.flatnonzero((counts > 0) & ~long):
        h = 0
        for w in words[first[t] : first[t + 1]].tolist():
            h = (h * int(_A) + w) & _MASK
        out[out_first[t]] = mix64(np.array([(h + int(counts[t])) & _MASK], np.uint64))[0]
    return out, out_first


def distinct_by_text(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and each text's first, total at the end."""
    h = h.copy()
    for i in range(len(first) - 1):
        h[first[i] : first[i + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[first[:-1][np.diff(first) > 0]] = True
    at = np.zeros(len(h) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return h[keep], at[first]
