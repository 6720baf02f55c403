"""Best-two-fit packing of tokenized documents into sequences of at most `size` tokens.

Lengths are what packing depends on, and there are at most `size` different ones, so the driver packs their histogram:
the largest unpacked length opens a bin, the bin is filled greedily with the largest lengths that fit, then its smallest
document gives way to two unpacked ones that fill the widened gap more tightly.  A bin's pattern is repeated as often
as the counts allow, so the work depends on `size` and not on the number of documents, and the whole corpus is packed
as one.  Documents are then ranked within their length (their number within the task that wrote them, plus the counts of
earlier tasks) and take the places of that rank.

Tokens: the tokenizer's ids of the whole text, then the end id.  Only longer documents are cut, into `size`-token
pieces, the first of which may be shorter.  A text is encoded by the pieces between its single spaces, where the
vocabulary's splitting rule always cuts; each distinct piece is encoded once and remembered.  Where a space stands
beside other white space or at an end, the segment (of about STEP_CHARS characters) is encoded as a whole, and so is a
text with a special token's string, which gets the special id as it does from the tokenizer.

Defined cases: null text counts as empty (one token, the end id); repeated rows are packed each; null doc_ids are packed
like others; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, utf8

SIZE, END, REMEMBERED, STEP_CHARS = 2048, 0, 450_000, 1 << 20

# The vocabulary's splitting rule, for text of the line end, visible ASCII and Latin-1 letters.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile("[\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_MARKED = re.compile(rf"([{_LETTERS}]+)([!-&(-/:-@\[-`{{-~]+)")
_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
#: Rows of counts that are broadcast at most (some 120 bytes each as a hash table).
MAX_COUNTS = 400_000
_encoders: dict[str, _Encoder] = {}


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: a visible Latin-1 byte stands for itself, the others for characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _segments(text: str) -> Iterator[str]:
    """text cut at single spaces (left out) into segments of little more than STEP_CHARS."""
    at = 0
    while len(text) - at > STEP_CHARS:
        cut = text.find(" ", at + STEP_CHARS)
        while cut >= 0 and (text[cut - 1].isspace() or not text[cut + 1 : cut + 2].strip()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


class _Odd(Exception):
    """A piece beside other white space."""


class _Bare(dict):
    """What the splitting rule leaves whole, with or without a space before it; a missing entry is made once."""

    def __init__(self, model: Callable) -> None:
        self.model, self.characters = model, _byte_characters()

    def __missing__(self, x: str) -> bytes:
        ids = self[x] = self.made(x)
        return ids

    def made(self, x: str) -> bytes:
        return array("I", [t.id for t in self.model(x.encode().decode("latin-1").translate(self.characters))]).tobytes()


class _Spaced(dict):
    """Pieces and the space before them; `older` is the last generation."""

    def __init__(self, model: Callable, whole: Callable, older: dict[str, bytes]) -> None:
        self.model, self.whole, self.older, self.bare = model, whole, older, _Bare(model)
        self.space = self.bare.characters[32]

    def __missing__(self, x: str) -> bytes:
        if (ids := self.older.get(x)) is None:
            if x.isascii() and x.isalpha():
                ids = array("I", [t.id for t in self.model(self.space + x)]).tobytes()
            elif m := _MARKED.fullmatch(x):
                ids = self[m[1]] + self.bare[m[2]]
            elif not x or x[0].isspace() or x[-1].isspace():
                raise _Odd
            elif _PLAIN.fullmatch(x):
                first, *more = _CUT.findall(f" {x}")
                ids = (self[first[1:]] if more else self.bare.made(first)) + b"".join(map(self.bare.__getitem__, more))
            else:
                ids = self.whole([f" {x}"])[0]
        self[x] = ids
        return ids


class _Encoder:
    """Texts to packed little-endian uint32 ids, for a tokenizer file.

    A piece between single spaces is encoded once and remembered: its parts under the splitting rule go to the
    tokenizer's model, and pieces with other characters to the whole tokenizer.  What is remembered is bounded: at
    REMEMBERED entries a generation ends, and pieces that come again are taken over from the last one.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = _Spaced(self.tokenizer.model.tokenize, self.whole, {})

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def segment(self, text: str, behind: bool) -> bytes:
        """The ids of a text, behind a space or not."""
        pieces, ids = text.split(" "), b""
        try:
            if not behind:
                head = pieces.pop(0)
                if pieces and (not head or head[-1].isspace()):
                    raise _Odd
                ids = b"".join(map(self.spaced.bare.__getitem__, _CUT.findall(head))) if _PLAIN.fullmatch(head) else self.whole([head])[0]
            return ids + b"".join(map(self.spaced.__getitem__, pieces))
        except _Odd:
            return self.whole([f" {text}" if behind else text])[0]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole([text])[0]
        if len(self.spaced) + len(self.spaced.bare) > REMEMBERED:
            self.spaced.older = {}
            self.spaced = _Spaced(self.spaced.model, self.whole, self.spaced)
        return b"".join([self.segment(x, k > 0) for k, x in enumerate(_segments(text))])


def encoder(path: str) -> _Encoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, nth[, raw]) of every document; nth numbers a task's pieces of one length.

    raw has the ids as little-endian 32-bit integers, which is cheaper to write and read than an array.
    """
    prepare(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth", *(["raw"] if with_ids else [])]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        tail = np.array([end], "<u4").tobytes()
        seen = [0] * (size + 1)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, ids in zip(batch.column(0).to_pylist(), map(encode, batch.column(1).to_pylist()), strict=True):
                ids += tail
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    upto = at + ((n % size or size) if k == 0 else size)
                    part = ids[4 * at : 4 * upto]
                    for o, v in zip(out, (doc_id, k, at, upto - at, zlib.crc32(part), seen[upto - at], part), strict=False):
                        o.append(v)
                    seen[upto - at] += 1
                    at, k = upto, k + 1
            kinds = [batch.schema.field(0).type, pa.int32(), *[pa.int64()] * 4]
            arrays = [pa.array(o, t) for o, t in zip(out, kinds, strict=False)]
            if with_ids:
                arrays.append(pa.array(out[6], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint" + ", raw binary" * with_ids)


def best_two_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a bin, descending) and how many bins have each, for so many documents of each length."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[list[int], int]] = []
    top = size
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return plan
        used = np.zeros(size + 1, np.int64)

        def free(upto: int, used=used) -> int:
            """The largest unpacked length of at most upto, 0 if none."""
            while upto > 0:
                found = np.flatnonzero(left[1 : upto + 1] > used[1 : upto + 1])
                return int(found[-1]) + 1 if len(found) else 0
            return 0

        bin_, gap = [top], size - top
        used[top] += 1
        while gap and (x := free(gap)):
            bin_.append(x)
            used[x] += 1
            gap -= x
        if gap and len(bin_) > 1:  # two unpacked documents in the place of the smallest one
            small = bin_[-1]
            room = gap + small
            have = left - used
            have[small] += 1
            a = np.arange(1, room // 2 + 1)
            best, pair = small, None
            can = np.flatnonzero(have > 0)
            if len(can):
                upto = np.zeros(size + 1, np.int64)
                upto[can] = can
                upto = np.maximum.accumulate(upto)  # the largest length there is up to each
                a = a[have[a] > 0]
                b = upto[room - a]
                same = (b == a) & (have[np.minimum(b, size)] < 2)
                if same.any():
                    b = np.where(same, upto[np.maximum(a - 1, 0)], b)
                total = np.where(b > 0, a + b, 0)
                if len(total) and total.max() > best:
                    k = int(total.argmax())
                    best, pair = int(total[k]), (int(max(a[k], b[k])), int(min(a[k], b[k])))
            if pair:
                bin_[-1:] = pair
                used[small] -= 1
                for x in pair:
                    used[x] += 1
        of = np.flatnonzero(used)
        times = int((left[of] // used[of]).min())
        left[of] -= used[of] * times
        plan.append((sorted(bin_, reverse=True), times))


def _places(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each pattern and length in it: ranks of that length from `rank`, `per` in a bin, first bin, first offset."""
    rank: dict[int, int] = {}
    rows, first = [], 0
    for bin_, times in plan:
        at = 0
        for length in dict.fromkeys(bin_):
            per = bin_.count(length)
            rows.append((length, rank.get(length, 0), per, first, at))
            rank[length] = rank.get(length, 0) + per * times
            at += per * length
        first += times
    rows.sort()
    return dict(zip(("length", "rank", "per", "bin", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces (of `tokenized`) with sequence_id and offset in place of nth, and ids (array<int>) in place of raw.

    A piece's rank among those of its length is its number in its task, fixed when the pieces are written, plus the
    count of earlier tasks.  So pieces with their ids aren't sorted; counts by (length, task) meet them, broadcast up to
    MAX_COUNTS rows and by a shuffle beyond.
    """
    kept = materialize(pieces.withColumn("__task", F.spark_partition_id()))
    spark = kept.sparkSession
    counts = materialize(kept.groupBy("length", "__task").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    places = spark.sparkContext.broadcast(_places(best_two_fit(histogram, size)))  # grows with size, not with the data
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("length", "__task", F.coalesce(before, F.lit(0)).alias("__first"))
    met = kept.join(F.broadcast(firsts) if counts.count() <= MAX_COUNTS else firsts, ["length", "__task"])

    @F.arrow_udf("sequence_id bigint, offset bigint")
    def place(length: pa.Array, at: pa.Array) -> pa.Array:
        p = places.value
        span = int(max(p["rank"].max() if len(p["rank"]) else 0, 1)) + 1
        n, rank = np.array(length, np.int64), np.array(at, np.int64)
        k = np.searchsorted(p["length"] * span + p["rank"], n * span + np.minimum(rank, span - 1), side="right") - 1
        bin_, nth = np.divmod(rank - p["rank"][k], p["per"][k])
        return pa.StructArray.from_arrays([pa.array(p["bin"][k] + bin_), pa.array(p["offset"][k] + nth * n)], names=["sequence_id", "offset"])

    @F.arrow_udf("array<int>")
    def listed(raw: pa.Array) -> pa.Array:
        data, offsets = utf8(raw)
        return pa.ListArray.from_arrays(pa.array(((offsets - offsets[0]) // 4).astype(np.int32)), pa.array(data[offsets[0] : offsets[-1]].view("<i4")))

    own = [listed("raw").alias("ids") if c == "raw" else F.col(c) for c in pieces.columns if c != "nth"]
    names = ["ids" if c == "raw" else c for c in pieces.columns if c != "nth"]
    return met.select(*own, place("length", F.col("__first") + F.col("nth")).alias("__place")).select(*names, "__place.*")


def pack_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, with_ids: bool = True) -> DataFrame:
    """Every piece of every document with its sequence and place; with_ids adds the token ids."""
    return pack(tokenized(docs, vocabulary, size, end, with_ids), size)


def without_ids(packed: DataFrame) -> DataFrame:
    """packed with ids_crc32 computed from its ids, which are dropped."""

    @F.arrow_udf("bigint")
    def digest(ids: pa.Array) -> pa.Array:
        at, raw = np.array(ids.offsets).tolist(), memoryview(np.array(ids.values, "<i4")).cast("B")
        return pa.array([zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(at, at[1:], strict=False)], pa.int64())

    return packed.withColumn("ids_crc32", digest("ids")).drop("ids")
