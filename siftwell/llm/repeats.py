"""Removal of long strings that an earlier document has, with suffix arrays of the places where texts part.

A byte is removed if a `size`-byte string that covers it also starts in a document with a smaller doc_id.  Each such
string has a minimizer: the 16-byte gram of least hash in it, at the same place wherever the string occurs.  So:

1. Every text, whole, gives its anchors (minimizers of its windows), each with a hash of the widest context that windows
   around the anchor can have.  Within a task, an anchor with the context of an earlier document's is decided at once:
   its windows all occur earlier.  One record per anchor and context (the earliest document's) goes on, packed.
2. Records meet by anchor.  Equal contexts are decided as before; an anchor with a single context is done.
3. What is left are anchors at which contexts part.  A string that two of them share holds the 17 bytes before the gram
   or the 17 after it, so a context goes on only for a side whose bytes another document has too.  Such contexts meet in
   shards by gram and side; each shard's suffix array (induced sorting) with its permuted common prefixes finds the
   strings of `size` bytes that contexts share.
4. Ranges are merged per document and cut out.

Since contexts are collapsed in every task before they meet, a passage that a third of the documents share is a few
records per task.  Anchors find the strings to be compared; bytes decide in step 3, and 64-bit hashes of contexts in
steps 1 and 2.

Defined cases: null text is the empty text; a null doc_id is neither smaller nor larger than others: nothing is removed
for it or from it; a doc_id should identify a text (rows that repeat it get the ranges found in any of them); texts
shorter than `size` stay whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powered, give_back, materialize, mix64, prepare, steps, tasks_for, utf8
from .suffixes import permuted_lcp, suffix_array

GRAM, FLUSH, STEP, PER_SHARD = 16, 150_000, 1 << 17, 8_000


def _anchors(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Anchors of consecutive texts: owner, key, context hash, hashes of the bytes before and after the gram (0 where the
    context has fewer), and within the text the gram's place and the context's end."""
    base = int(offsets[0])
    b = data[base : int(offsets[-1])]
    n, cuts = len(b), (offsets - base).astype(np.int64)
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, 2), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n < size:
        return none
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = b
    words = np.lib.stride_tricks.as_strided(padded.view(), (n + 1, 8), (1, 1)).copy().view(np.uint64).ravel()
    g = mix64(words[: n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15) + mix64(words[8 : n - GRAM + 9]))
    v = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    wide = size - GRAM + 1
    m, span = v, 1
    while 2 * span <= wide:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    m = np.minimum(m[: len(m) - (wide - span)], m[wide - span :]) if wide > span else m
    starts = np.zeros(n + 1, np.int32)  # window starts that lie in one text
    long = np.diff(cuts) >= size
    starts[cuts[:-1][long]] += 1
    np.add.at(starts, cuts[1:][long] - size + 1, -1)
    at = (m[np.cumsum(starts)[: len(m)] > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(at):
        return none
    at = at[np.append(True, at[1:] != at[:-1])]
    owner = np.searchsorted(cuts, at, side="right") - 1
    lo = np.maximum(at - (size - GRAM), cuts[owner])
    end = np.minimum(at + size, cuts[owner + 1])
    pw, inv = _powered(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * pw[:n], out=total[1:])
    shape = ((at - lo) * 256 + (end - at)).astype(np.uint64)
    ctx = mix64(((total[end] - total[lo]) * inv[lo]) ^ mix64(shape + np.uint64(1)))
    half, near = (size - GRAM) // 2, np.zeros((len(at), 2), np.uint32)
    for side, (a, e) in enumerate(((at - half, at), (at + GRAM, at + GRAM + half))):
        some = np.flatnonzero((a >= lo) & (e <= end))
        a, e = a[some], e[some]
        near[some, side] = (mix64((total[e] - total[a]) * inv[a]) >> np.uint64(32)) | np.uint64(1)
    return owner, g[at], ctx, near, at - cuts[owner], end - cuts[owner]


def _merged(doc: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document, joined where they overlap or touch."""
    if not len(doc):
        return doc, lo, end
    order = np.lexsort((lo, doc))
    doc, lo, end = doc[order], lo[order], end[order]
    _, rank = np.unique(doc, return_inverse=True)
    far = rank.astype(np.int64) << np.int64(40)
    reach = np.maximum.accumulate(far + end)
    new = np.append(True, far[1:] + lo[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], lo[first], reach[np.append(first[1:], len(doc)) - 1] - far[first]


def _late(key: np.ndarray, ctx: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which records have the key and context of a document with a smaller id."""
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    some = order[np.append(False, same) | np.append(same, False)]
    late = np.zeros(len(key), bool)
    if len(some):
        some = some[np.lexsort((doc[some], ctx[some], key[some]))]
        new = np.append(True, (key[some][1:] != key[some][:-1]) | (ctx[some][1:] != ctx[some][:-1]))
        late[some] = doc[some] > doc[some][np.flatnonzero(new)][np.cumsum(new) - 1]
    return late


def _numbered(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal ids as (ids, number of the run)."""
    new = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
    return doc[new], np.cumsum(new) - 1


_SENT = "bucket int, docs array<bigint>, of binary, key binary, ctx binary, near binary, at binary, width binary"


def _collect(size: int, buckets: int):
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n, turn = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, n, turn
            if not n:
                return
            doc, key, ctx, near, at, end = (np.concatenate(x) for x in zip(*held, strict=True))
            held, n, turn = [], 0, turn + 1
            late = _late(key, ctx, doc)
            out: list[tuple] = []
            if late.any():
                d, a, e = _merged(doc[late], np.maximum(at[late] - (size - GRAM), 0), end[late])
                out.append((turn % buckets, *_numbered(d), None, None, None, a, e - a))
            doc, key, ctx, near, at, width = (x[~late] for x in (doc, key, ctx, near, at, end - at))
            bucket = (((mix64(key) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint32)  # least hashes aren't evenly spread
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")  # in a bucket, documents stay together
            doc, key, ctx, near, at, width, bucket = (x[order] for x in (doc, key, ctx, near, at, width, bucket))
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
            for a, e in zip(first.tolist(), [*first[1:].tolist(), len(doc)], strict=False):
                out.append((int(bucket[a]), *_numbered(doc[a:e]), key[a:e].astype(np.uint32), ctx[a:e], near[a:e], at[a:e], width[a:e]))
            for rows in (out[i : i + 64] for i in range(0, len(out), 64)):
                packed = lambda c, t: pa.array([None if r[c] is None else r[c].astype(t).tobytes() for r in rows], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), packed(2, np.uint32), packed(3, np.uint32), packed(4, np.uint64), packed(5, np.uint32), packed(6, np.uint32), packed(7, np.uint32)],
                    names=["bucket", "docs", "of", "key", "ctx", "near", "at", "width"],
                )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            for lo, hi in steps(offsets, STEP):
                owner, *rest = _anchors(data, offsets[lo : hi + 1], size)
                if len(owner):
                    held.append((ids[lo + owner], *rest))
                    n += len(owner)
                if n >= FLUSH:
                    yield from flush()
        yield from flush()
        give_back()

    return collect


_FOUND = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("lo", pa.int64()), ("end", pa.int64())])


def _near(doc: np.ndarray, key: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Which records share their key and these bytes with a record of another document."""
    out = np.zeros(len(doc), bool)
    some = np.flatnonzero(near)
    order = some[np.lexsort((near[some], key[some]))]
    if len(order):
        k, v, d = key[order], near[order], doc[order]
        new = np.append(True, (k[1:] != k[:-1]) | (v[1:] != v[:-1]))
        heads = np.flatnonzero(new)
        out[order] = (np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads))[np.cumsum(new) - 1]
    return out


def _meeting(size: int):
    span, half = size - GRAM, (size - GRAM) // 2

    def meet(table: pa.Table) -> pa.Table:
        """Decide what equal contexts decide; a null key marks a range to remove, another key an open context.

        Two contexts with a string of `size` bytes in common around their gram share the `half` bytes before it or those
        after it.  So an open context goes on for each side that it shares with another document, under a key of the gram and
        those bytes, and as the part in which the strings that hold them can lie.
        """
        out: list[tuple] = []
        kept: list[tuple] = []
        is_key = table.column("key").is_valid()
        rows = table.filter(is_key)
        keys = [np.frombuffer(x.as_py(), np.uint32) for x in rows.column("key")]
        shared = np.zeros(sum(map(len, keys)), bool)  # a key with one record decides nothing
        if len(shared):
            key = np.concatenate(keys)
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            shared[order] = np.append(False, same) | np.append(same, False)
            del order, same, key
        first = 0
        for docs, of, ctx, near, at, width, key in zip(*(rows.column(c) for c in ("docs", "of", "ctx", "near", "at", "width")), keys, strict=True):
            pick = np.flatnonzero(shared[first : first + len(key)])
            first += len(key)
            if len(pick):
                place = np.frombuffer(at.as_py(), np.uint32)[pick].astype(np.int64)
                doc = np.array(docs.values, np.int64)[np.frombuffer(of.as_py(), np.uint32)[pick]]
                kept.append((doc, key[pick], np.frombuffer(ctx.as_py(), np.uint64)[pick], np.frombuffer(near.as_py(), np.uint32).reshape(-1, 2)[pick], place, place + np.frombuffer(width.as_py(), np.uint32)[pick]))
        del rows, keys, shared
        for docs, of, at, width in zip(*(table.filter(pc.invert(is_key)).column(c) for c in ("docs", "of", "at", "width")), strict=True):
            lo = np.frombuffer(at.as_py(), np.uint32).astype(np.int64)
            out.append((np.array(docs.values, np.int64)[np.frombuffer(of.as_py(), np.uint32)], lo, lo + np.frombuffer(width.as_py(), np.uint32)))
        going: list[tuple] = [(np.zeros(0, np.int64),) * 4]
        if kept:
            doc, key, ctx, near, at, end = (np.concatenate(x) for x in zip(*kept, strict=True))
            del kept
            order = np.lexsort((doc, ctx, key))
            doc, key, ctx, near, at, end = doc[order], key[order], ctx[order], near[order], at[order], end[order]
            new = np.append(True, (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1]))
            late = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            out.append((doc[late], np.maximum(at[late] - span, 0), end[late]))
            doc, key, near, at, end = (x[~late] for x in (doc, key, near, at, end))
            for side in range(2):
                on = _near(doc, key, near[:, side])
                lo = at[on] - (half if side else span)
                upto = end[on] if side else np.minimum(end[on], at[on] + size - half)
                of = mix64((key[on].astype(np.uint64) << np.uint64(32) | near[on, side]) + np.uint64(side)).view(np.int64)
                going.append((doc[on], of, np.maximum(lo, 0), upto))
        doc, lo, end = _merged(*(np.concatenate(x) for x in zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 3
        open_ = [np.concatenate(x) for x in zip(*going, strict=True)]
        keys = pa.array(np.append(np.zeros(len(doc), np.int64), open_[1]), mask=np.arange(len(doc) + len(open_[0])) < len(doc))
        del out, going
        give_back()
        return pa.Table.from_arrays([pa.array(np.append(doc, open_[0])), keys, pa.array(np.append(lo, open_[2])), pa.array(np.append(end, open_[3]))], schema=_FOUND)

    return meet


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the open contexts out of texts."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        places = batch.column(2)
        at = np.diff(np.array(places.offsets))
        flat = places.flatten()
        key, lo, end = (np.array(flat.field(i), np.int64) for i in range(3))
        owner = np.repeat(np.arange(len(at)), at)
        begin = offsets[owner] + lo
        parts = [data[b : b + n].tobytes() for b, n in zip(begin.tolist(), (end - lo).tolist(), strict=True)]
        doc = np.array(batch.column(0), np.int64)[owner]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(lo), pa.array(parts, pa.binary())], names=["key", "doc_id", "lo", "part"])


def _sorted_shard(size: int):
    def shard(table: pa.Table) -> pa.Table:
        """Ranges whose strings another context of the same shard has from an earlier document."""
        coded = table.column("part").combine_chunks().dictionary_encode()  # equal contexts are sorted once
        parts, of = coded.dictionary.to_pylist(), np.array(coded.indices, np.int64)
        doc, lo = np.array(table.column("doc_id"), np.int64), np.array(table.column("lo"), np.int64)
        first = np.full(len(parts), np.iinfo(np.int64).max)
        np.minimum.at(first, of, doc)
        n = np.array([len(x) for x in parts], np.int64)
        t = np.frombuffer(b"\xff".join(parts), np.uint8)  # 0xFF is in no UTF-8 text
        begins = np.cumsum(n + 1) - n - 1
        sa = suffix_array(t)
        near = permuted_lcp(t, sa, size)[sa] >= size
        owner = np.searchsorted(begins, sa, side="right") - 1
        valid = sa - begins[owner] + size <= n[owner]
        near, owner, sa = near[valid], owner[valid], sa[valid]
        if not len(sa):
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 3, names=["doc_id", "lo", "end"])
        near[0] = False
        heads = np.flatnonzero(~near)
        least = np.minimum.reduceat(first[owner], heads)[np.cumsum(~near) - 1]
        late = first[owner] >= least  # of the least document's own context, other documents' occurrences may be late
        owner, at, least = owner[late], sa[late] - begins[owner[late]], least[late]
        order = np.argsort(owner, kind="stable")
        owner, at, least = owner[order], at[order], least[order]
        begin, stop = np.searchsorted(owner, of), np.searchsorted(owner, of, side="right")
        times = stop - begin
        row = np.repeat(np.arange(len(of)), times)
        pick = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + begin[row]
        keep = doc[row] > least[pick]
        row, a = row[keep], lo[row[keep]] + at[pick[keep]]
        d, a, e = _merged(doc[row], a, a + size)
        return pa.Table.from_arrays([pa.array(d), pa.array(a), pa.array(e)], names=["doc_id", "lo", "end"])

    return shard


def repeated_ranges(docs: DataFrame, size: int = 50) -> DataFrame:
    """(doc_id, lo, end): byte ranges to remove, some overlapping."""
    prepare(spark := docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    total = own.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = tasks_for(spark, total, 6_000_000)
    sent = own.mapInArrow(_collect(size, buckets), _SENT)
    found = materialize(sent.repartition(2 * buckets, "bucket").groupBy("bucket").applyInArrow(_meeting(size), "doc_id bigint, key bigint, lo bigint, end bigint"))
    gone = found.filter("key is null").select("doc_id", "lo", "end")
    open_ = found.filter("key is not null")
    shards = tasks_for(spark, open_.count(), PER_SHARD)
    places = open_.groupBy("doc_id").agg(F.collect_list(F.struct("key", "lo", "end")).alias("places"))
    parts = own.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(_contexts, "key bigint, doc_id bigint, lo bigint, part binary")
    by_shard = parts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard")
    return gone.union(by_shard.applyInArrow(_sorted_shard(size), "doc_id bigint, lo bigint, end bigint"))


def remove_repeats(docs: DataFrame, size: int = 50, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept bytes]) of every document."""
    prepare(docs.sparkSession)
    ranges = repeated_ranges(docs, size).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "end")).alias("ranges"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text").join(ranges, "doc_id", "left")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out: list[list] = [[] for _ in names[1:]]
            for i, r in enumerate(batch.column(2)):
                text, spans = data[offsets[i] : offsets[i + 1]], []
                if (x := r.values) is not None and len(x):
                    lo, end = (np.array(x.field(k), np.int64) for k in range(2))
                    end = np.minimum(end, len(text))
                    fits = end > lo
                    _, lo, end = _merged(np.zeros(fits.sum(), np.int64), lo[fits], end[fits])
                    spans = list(zip(lo.tolist(), end.tolist(), strict=True))
                kept, at = [], 0
                for a, e in spans:
                    kept.append(text[at:a].tobytes())
                    at = e
                left = b"".join([*kept, text[at:].tobytes()])
                for o, v in zip(out, (len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left), strict=False):
                    o.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, t) for o, t in zip(out, kinds, strict=False))], names=names)

    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)
