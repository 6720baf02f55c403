"""Near-duplicate detection with circulant MinHash.

A document is its set of k-word shingles.  Two permutations of the 32-bit universe give all signature coordinates: one
deals the shingles out, the other, shifted circularly by 0, 1, 2, ... places, orders them for each coordinate.  Bands of
ROWS coordinates bring candidates together; the number of bands makes a pair at the threshold fail all of them with a
probability below 1e-6.  Links are confirmed by exact Jaccard similarity of the full sets.

Documents with equal sets are one node.  Within a bucket not all pairs are made: the member that meets most others is
compared with the rest, verified links are merged to components, and only members of different components go on, under
the next such member.  After LEADERS rounds, what is left of small buckets is compared pairwise across components.  The
members left in larger buckets meet again by shingle: two sets of the wanted similarity share a shingle among the
100 - percent in a hundred of each that are rarest (in one order for all, by a counting sketch of those members, then by
hash), so passages that many texts share bring no one together.  Pairs that share such a shingle are verified; a shingle
that is among the rarest of more than PAIRS members is compared in tiles of 2 x TILE members, where a task holds a tile's
sets and emits the links that connect something.  So no pair that shares a bucket is left undecided except inside one
component.  Components come from min-label propagation with pointer jumping, in tables in the shared folder.

Defined cases: null, empty or wordless texts have no shingles and link with nothing; 1 to k-1 words are one shingle;
repeated rows link to each other; a null doc_id links with nothing and its component is null; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_by_text, fresh, give_back, materialize, mix64, prepare, shingle_hashes, steps, utf8, word_hashes

ROWS, MISS, LEADERS, SMALL, PAIRS, TILE = 5, 1e-6, 2, 8, 64, 1000
SKETCH_BITS, SLICES = 18, 64


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def _mix32(z: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    t = z >> np.uint32(16)
    z ^= t
    z *= np.uint32(0x85EBCA6B)
    np.right_shift(z, np.uint32(13), out=t)
    z ^= t
    z *= np.uint32(0xC2B2AE35)
    np.right_shift(z, np.uint32(16), out=t)
    z ^= t
    return z


def signatures(h: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: [coordinates, sets] of uint32."""
    dealt = _mix32((h ^ (h >> np.uint64(29))).astype(np.uint32))
    out = np.full((coordinates, len(first) - 1), 0xFFFFFFFF, np.uint32)
    most = 1 << 16  # so many shingles at a time stay in the processor's cache
    for lo in range(0, len(dealt), most):
        part = dealt[lo : lo + most]
        a, b = np.searchsorted(first, lo, side="right") - 1, np.searchsorted(first, lo + len(part), side="left")
        starts = np.maximum(first[a:b] - lo, 0)
        for j in range(coordinates):
            np.minimum(out[j, a:b], np.minimum.reduceat(_mix32(part + np.uint32(j)), starts), out=out[j, a:b])
    return out


def _sign(k: int, bands: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in steps(offsets):
                w, _, _, at = word_hashes(data, offsets[lo : hi + 1])
                h, first = distinct_by_text(*shingle_hashes(w, at, k))
                n = np.diff(first)
                full = np.flatnonzero(n)
                keys, k1, k2 = np.zeros((len(full), bands), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                if len(full):
                    begins = first[:-1][full]
                    sig = signatures(h, np.append(begins, len(h)), bands * ROWS).astype(np.uint64)
                    for b in range(bands):
                        x = np.full(len(full), b + 1, np.uint64)
                        for r in range(ROWS):
                            x = mix64(x + sig[b * ROWS + r])
                        keys[:, b] = x.view(np.int64)
                    k1[full] = np.add.reduceat(mix64(h), begins).view(np.int64)
                    k2[full] = np.add.reduceat(mix64(h ^ np.uint64(0x5555555555555555)), begins).view(np.int64)
                of = np.zeros(len(n) + 1, np.int32)
                of[1:] = np.cumsum(np.where(n > 0, bands, 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(k1), pa.array(k2), pa.ListArray.from_arrays(pa.array(of), pa.array(keys.ravel()))],
                    names=["doc_id", "t", "n", "k1", "k2", "bands"],
                )

    return sign


def _verify(k: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column: pa.Array) -> list[np.ndarray]:
            return [h[first[i] : first[i + 1]] for lo, hi, h, first in _sets(column, k) for i in range(hi - lo)]

        for batch in batches:
            ok = []
            for x, y in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ok)], names=["a", "b", "ok"])

    return verify


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Steps of texts: first and end row, sorted shingle hashes text by text, each text's first and the total."""
    data, offsets = utf8(column)
    for lo, hi in steps(offsets):
        w, _, _, at = word_hashes(data, offsets[lo : hi + 1])
        yield lo, hi, *distinct_by_text(*shingle_hashes(w, at, k))


def _sketch(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's counts of shingles by their leading bits, in slices."""
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, _, h, _ in _sets(batch.column(0), k):
                total += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(list(total.reshape(SLICES, -1)), pa.list_(pa.int64()))], names=["slice", "counts"])

    return sketch


def _rarest(k: int, percent: int, counts):
    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, rep, n, comp) for the rarest shingles of each set: as many as similar sets can't all lack."""
        often = counts.value
        for batch in batches:
            for lo, hi, h, first in _sets(batch.column(3), k):
                n = np.diff(first)
                owner = np.repeat(np.arange(hi - lo), n)
                order = np.lexsort((h, often[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], owner))
                place = np.arange(len(h)) - np.repeat(first[:-1], n)
                keep = place < np.repeat(n - -(-percent * n // 100) + 1, n)
                at = pa.array(lo + owner[keep])
                own = [batch.column(c).take(at) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(h[order][keep].view(np.int64)), *own], names=["key", "rep", "n", "comp"])

    return rarest


def _met_by_shingle(left: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, rep, n, comp, m): members of different components that share one of their rarest shingles, m of them."""
    parts = left.select("text").mapInArrow(_sketch(k), "slice int, counts array<bigint>").select("slice", F.posexplode("counts").alias("at", "n"))
    table = parts.groupBy("slice", "at").agg(F.sum("n").alias("n")).filter("n > 0").toArrow()  # at most 2^SKETCH_BITS rows
    often = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.int64)
    often[np.array(table.column("slice")), np.array(table.column("at"))] = np.array(table.column("n"))
    counts = left.sparkSession.sparkContext.broadcast(often.ravel())
    keys = materialize(left.select("rep", "n", "comp", "text").mapInArrow(_rarest(k, percent, counts), "key bigint, rep bigint, n bigint, comp bigint"))
    met = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key", "m")
    return materialize(keys.join(met, "key"))


def _tile(k: int, percent: int):
    def tile(table: pa.Table) -> pa.Table:
        """Links that connect components among a tile's members."""
        table = table.sort_by("rep").combine_chunks()
        rep, n, block = (np.array(table.column(c), np.int64) for c in ("rep", "n", "block"))
        _, root = np.unique(np.array(table.column("comp"), np.int64), return_inverse=True)
        sets = []
        for lo, hi, h, first in _sets(table.column("text"), k):
            sets += [h[first[i] : first[i + 1]] for i in range(hi - lo)]
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(n) - n
        mark = np.zeros(len(values), np.int32)
        across = table.column("t0")[0] != table.column("t1")[0]
        links: list[tuple[int, int]] = []
        for x in range(len(rep) - 1):
            todo = (root != root[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
            todo[: x + 1] = False
            if across:
                todo &= block != block[x]
            if not todo.any():
                continue
            own = ids[starts[x] : starts[x] + n[x]]
            mark[own] = 1
            both = np.add.reduceat(mark[ids], starts)
            mark[own] = 0
            for y in np.flatnonzero(todo & (100 * both >= percent * (n + n[x] - both))).tolist():
                if root[y] != root[x]:
                    links.append((int(rep[x]), int(rep[y])))
                    root[root == root[y]] = root[x]
        give_back()
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tile


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that edges (a, b) connect each node with."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hooked = labels.join(seen, "node").select("node", F.least("comp", "near").alias("new"), F.col("comp").alias("old"))
        up = labels.select(F.col("node").alias("new"), F.col("comp").alias("above"))
        labels = materialize(hooked.join(up, "new").select("node", F.least("new", "above").alias("comp"), (F.least("new", "above") != F.col("old")).alias("moved")))
        if labels.filter("moved").isEmpty():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, t, n, least) of every row: t tells the texts of one doc_id apart, least is the least (doc_id, t) of the row's group."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    signed = materialize(named.mapInArrow(_sign(k, bands_for(percent)), f"doc_id {kind}, t bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>"))
    usable = signed.filter("n > 0 and doc_id is not null")
    # A node is a set of shingles: a doc_id that stands on several texts is in several nodes.
    reps = materialize(usable.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "t")).alias("least")).withColumn("rep", F.monotonically_increasing_id()))
    nodes = usable.join(reps.select("rep", "k1", "k2", "least.*"), ["doc_id", "t", "k1", "k2"]).select("rep", "n", "bands").dropDuplicates(["rep"])
    members = nodes.select("rep", "n", F.explode(F.array_distinct("bands")).alias("key")).distinct()
    met = members.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    active = materialize(members.join(met, "key"))
    degrees = active.groupBy("rep").agg(F.sum(F.col("m") - 1).alias("deg"))
    active = materialize(active.join(degrees, "rep").select("key", "rep", "n", "deg"))
    texts = materialize(
        named.join(reps.join(degrees.select("rep"), "rep", "left_semi").select("rep", "least.*"), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).select("rep", "text")
    )
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    links, decided, comps = None, None, None
    for turn in range(LEADERS + 1):
        with_comp = active.withColumn("comp", F.col("rep")) if comps is None else active.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        open_ = with_comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.max(F.struct("deg", F.negate("rep").alias("minus"), "rep", "n", "comp")).alias("lead")).filter("lo != hi")
        going = materialize(with_comp.join(open_.select("key", "m", "lead"), "key"))
        if going.isEmpty():
            break
        if turn == LEADERS:
            left = materialize(going.filter(F.col("m") > SMALL).select("rep", "n", "comp").distinct().join(texts, "rep"))
            meets = [going.filter(F.col("m") <= SMALL)] + ([] if left.isEmpty() else [hot := _met_by_shingle(left, k, percent)])
            across = [x.filter(F.col("m") <= PAIRS).select("key", "rep", "n", "comp") for x in meets]
            pairs = None
            for x, y in ((c.alias("x"), c.alias("y")) for c in across):
                one = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp")) & fits(F.col("x.n"), F.col("y.n")))
                one = one.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
                pairs = one if pairs is None else pairs.union(one)
        else:
            pairs = going.filter((F.col("rep") != F.col("lead.rep")) & (F.col("comp") != F.col("lead.comp")) & fits(F.col("n"), F.col("lead.n")))
            pairs = pairs.select(F.least("lead.rep", "rep").alias("a"), F.greatest("lead.rep", "rep").alias("b"))
            active = going.filter(F.col("rep") != F.col("lead.rep")).select("key", "rep", "n", "deg")
        pairs = pairs.distinct()
        if decided is not None:
            pairs = pairs.join(decided, ["a", "b"], "left_anti")
        known = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
        judged = materialize(known.select("a", "b", "ta", "tb").mapInArrow(_verify(k, percent), "a bigint, b bigint, ok boolean"))
        decided = judged.select("a", "b") if decided is None else decided.union(judged.select("a", "b"))
        new = judged.filter("ok").select("a", "b")
        if turn == LEADERS:
            if len(meets) > 1:
                large = hot.filter(F.col("m") > PAIRS).withColumn("blocks", F.ceil(F.col("m") / TILE)).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
                large = large.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("key", "rep", "n", "comp", "block", F.least("block", "other").alias("t0"), F.greatest("block", "other").alias("t1"))
                new = new.union(large.join(texts, "rep").groupBy("key", "t0", "t1").applyInArrow(_tile(k, percent), "a bigint, b bigint"))
        new = materialize(new)
        links = new if links is None else links.union(new)
        if not new.isEmpty():
            comps = components(links)
    owner = reps.withColumn("comp", F.col("rep")) if comps is None else reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    owner = owner.join(owner.groupBy("comp").agg(F.min("least").alias("first")), "comp").select("k1", "k2", F.col("first").alias("least"))
    out = signed.select("doc_id", "t", "n", "k1", "k2").join(owner, ["k1", "k2"], "left")
    return out.select("doc_id", "t", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("least")).alias("least"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    component = F.coalesce("least.doc_id", "doc_id")
    return _grouped(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group (the smallest doc_id; of rows that repeat it, one); rows without doc_id stay.

    Rows are told apart by doc_id and text, so a doc_id that stands on several texts loses only those with a copy.
    """
    t = fresh(docs, "_t")
    gone = _grouped(docs, k, percent).filter("least.doc_id != doc_id or least.t != t").select("doc_id", F.col("t").alias(t)).distinct()
    named = docs.filter("doc_id is not null").withColumn(t, F.xxhash64("text"))
    identified = named.join(gone, ["doc_id", t], "left_anti").dropDuplicates(["doc_id", t, "text"])
    return identified.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
