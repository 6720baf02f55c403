"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items are partitioned by their number of k-word shingles (powers of two).  For the class of size s every document,
however long, is seen through windows of 2s shingles that start every s, so an item of the class lies in a window whole
and its Jaccard similarity with that window is bounded below (0.19 at a containment of 0.8), whatever the document's
length.  A window that shares one of 64 MinHash values with an item makes (document, item) a candidate: a contained
item is missed with probability below 2e-6.  Candidates are verified on the shingles of the whole document and item.

Items are a stated query set: they are streamed in blocks of at most BLOCK_BYTES of text, and each block (its size is
therefore bounded) is broadcast to one pass over all documents.

Words are runs of characters other than 0x20 and 0x09-0x0D, A-Z lower-cased.  A text with 1 to k-1 words has its whole
sequence as its only shingle.  Defined cases: null or wordless documents and items match nothing; repeated items are
searched once; repeated documents are reported each; null ids are passed through; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, joinable, prepare, shingle_hashes, steps, utf8, word_hashes

HASHES, BLOCK_BYTES, LEAST_CLASS = 64, 4 << 20, 4
_r = np.random.RandomState(7)
_MUL = _r.randint(1 << 30, (1 << 31) - 1, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _r.randint(0, (1 << 31) - 1, HASHES).astype(np.uint32)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text: str | None, k: int) -> set[tuple[str, ...]]:
    words = _WORD.findall((text or "").translate(_ASCII_LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _hashed(s: np.ndarray, j: int) -> np.ndarray:
    h = s * _MUL[j] + _ADD[j]
    h ^= h >> np.uint32(15)
    return h * np.uint32(0x2C1B3C6D)


def _narrow(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint32)


class _Block:
    """The items of a block, by size class, with their MinHash values."""

    def __init__(self, items: list[tuple], k: int) -> None:
        self.ids, self.hashes = [], []
        by_class: dict[int, list[int]] = {}
        for item_id, text in items:
            data, offsets = utf8(pa.array([text], pa.string()))
            w, _, _, first = word_hashes(data, offsets)
            h = np.unique(shingle_hashes(w, first, k)[0])
            if len(h):
                by_class.setdefault(max(LEAST_CLASS, 1 << (len(h) - 1).bit_length()), []).append(len(self.ids))
                self.ids.append(item_id)
                self.hashes.append(h)
        self.texts = {i: t for i, t in enumerate(t for _, t in items if shingle_set(t, k))}
        self.classes = {}
        for size, members in sorted(by_class.items()):
            sigs = np.array([[_hashed(_narrow(self.hashes[m]), j).min() for j in range(HASHES)] for m in members], np.uint32)
            seen = np.zeros((HASHES, 1 << 16), bool)
            for j in range(HASHES):
                seen[j, sigs[:, j] >> np.uint32(16)] = True
            of: list[dict[int, list[int]]] = [{} for _ in range(HASHES)]
            for m, sig in zip(members, sigs.tolist(), strict=True):
                for j, v in enumerate(sig):
                    of[j].setdefault(v, []).append(m)
            self.classes[size] = (seen, of)

    def candidates(self, s: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs whose windows share a MinHash value; s: shingles of consecutive texts."""
        counts, s32, found = np.diff(first), _narrow(s), set()
        levels = [1 << x for x in range(min(self.classes).bit_length() - 1, max(self.classes).bit_length())]
        plan, begins, n = [], first[:-1], counts
        for i, size in enumerate(levels):
            per = -(-n // (size if i == 0 else 2))
            at = np.concatenate([[0], np.cumsum(per)])
            owner = np.repeat(np.arange(len(per)), per)
            starts = np.repeat(begins, per) + (np.arange(at[-1]) - np.repeat(at[:-1], per)) * (size if i == 0 else 2)
            last = np.zeros(at[-1], bool)
            last[at[1:][per > 0] - 1] = True
            plan.append((size, starts, owner, last))
            begins, n = at[:-1], per
        for j in range(HASHES):
            b = _hashed(s32, j)
            for size, starts, owner, last in plan:
                b = np.minimum.reduceat(b, starts)
                if size in self.classes:
                    seen, of = self.classes[size]
                    window = b.copy()
                    np.minimum(b[:-1], b[1:], out=window[:-1], where=~last[:-1])
                    for at in np.flatnonzero(seen[j, window >> np.uint32(16)]).tolist():
                        found.update((int(owner[at]), m) for m in of[j].get(int(window[at]), ()))
        return found


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1].encode())
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): documents that contain at least `percent` of an item's k-word shingles."""
    prepare(spark := docs.sparkSession)
    wanted = items.select("item_id", "text").filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).dropDuplicates().orderBy("item_id", "text")
    doc_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, n_shared bigint, n_item bigint"
    out = spark.createDataFrame([], schema)
    for block in _blocks(wanted):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _Block(shared.value, k)
            for batch in batches:
                rows, (data, offsets) = [], utf8(batch.column(1))
                for lo, hi in steps(offsets):
                    w, _, _, first = word_hashes(data, offsets[lo : hi + 1])
                    s, at = shingle_hashes(w, first, k)
                    by_doc: dict[int, list[int]] = {}
                    for d, m in items.candidates(s, at) if len(s) else ():
                        by_doc.setdefault(d, []).append(m)
                    for d, members in by_doc.items():
                        h, exact = np.unique(s[at[d] : at[d + 1]]), None
                        for m in sorted(members):
                            if 100 * np.isin(items.hashes[m], h, assume_unique=True).sum() < percent * len(items.hashes[m]):
                                continue
                            exact = exact or shingle_set(batch.column(1)[lo + d].as_py(), k)
                            wanted = shingle_set(items.texts[m], k)
                            if 100 * (n := len(wanted & exact)) >= percent * len(wanted):
                                rows.append((lo + d, items.ids[m], n, len(wanted)))
                if rows:
                    at, ids, n, of = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pc.take(batch.column(0), pa.array(at)), pa.array(ids), pa.array(n, pa.int64()), pa.array(of, pa.int64())], names=["doc_id", "item_id", "n_shared", "n_item"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(search, schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that contain no item; documents with a null doc_id are judged by their own text, as a group of one."""
    key = fresh(docs, "_row")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")), F.length("text")))
    hits = contained_items(keyed.select(F.col(key).alias("doc_id"), "text"), items, k, percent).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(joinable(hits), key, "left_anti").select(*docs.columns)
