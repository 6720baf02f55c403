"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram counts per language in every task and merges them by (language, slice of the buckets), so no task
gathers a language; the driver receives languages x buckets counts, whose number is checked.  The log-probability matrix
is broadcast (buckets x languages float32, at most MAX_LANGS languages).  Texts are scored in numpy over their whole
length: a step of texts becomes one sparse matrix (row, bucket, count), whose product with the log-probabilities is
summed over the rows' segments.

Defined cases: null text, or a text without a letter, is `und` with score 0; rows with null text or null language are
not learned from; with nothing to learn every text is `und`; repeated rows count each time; an empty table gives an
empty result; columns other than text (and the label in training) are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

BUCKETS, ORDERS, SLICES, MAX_LANGS = 1 << 14, (1, 2, 3), 32, 4096
_M = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
STEP_CHARS, STEP_ROWS = 1 << 18, 8

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points; each run of other characters than letters becomes one space, also at both ends."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_is_letter()[c], c, np.uint32(32))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    return c[keep]


def _grams(c: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a run of code points, one array for each order."""
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for n in ORDERS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint32)
            for j in range(n):
                h = (h ^ c[j : j + len(h)]) * _M[j]
                h ^= h >> np.uint32(15)
            yield (h * _M[0]) >> shift


def _counts(text: str) -> np.ndarray:
    """How often each bucket occurs in a whole text."""
    c, total = _codes(text), np.zeros(BUCKETS, np.int64)
    for at in range(0, len(c), STEP_CHARS):  # n-grams that begin in this step; they may end in the next
        for h in _grams(c[at : at + STEP_CHARS + max(ORDERS) - 1]):
            total += np.bincount(h[: min(len(h), STEP_CHARS)], minlength=BUCKETS)
    return total


def _sparse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of several texts as a sparse matrix: the rows' first entries (and the total), buckets, counts."""
    parts = [_codes(t) for t in texts]
    c = np.concatenate(parts)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in parts])
    own = row * BUCKETS
    cells = []
    for n, h in zip(ORDERS, _grams(c), strict=False):
        inside = row[: len(h)] == row[n - 1 : n - 1 + len(h)]  # no n-gram runs from one text into the next
        cells.append((own[: len(h)] + h)[inside])
    total = np.bincount(np.concatenate(cells), minlength=len(texts) * BUCKETS)
    at = np.flatnonzero(total)
    return np.searchsorted(at, np.arange(len(texts) + 1) * BUCKETS), at % BUCKETS, total[at]


def _joint(first: np.ndarray, bucket: np.ndarray, count: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log joint probabilities [rows, languages] of a sparse matrix without empty rows, some languages at a time."""
    out = np.empty((len(first) - 1, table.shape[1]))
    for c in range(0, table.shape[1], 32):
        out[:, c : c + 32] = np.add.reduceat(count[:, None] * table[bucket, c : c + 32].astype(np.float64), first[:-1])
    return out + table[-1]


def _step_of(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts that are scored together; a text longer than STEP_CHARS is alone."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if held and (size + len(t) > STEP_CHARS or len(held) >= STEP_ROWS):
            yield held
            held, size = [], 0
        held.append(i)
        size += len(t)
    if held:
        yield held


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            if (got := total.get(k := lang.as_py())) is None:
                got = total[k] = np.zeros(BUCKETS, np.int64)
            got += _counts(text.as_py())
    for lang, counts in sorted(total.items()):
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * SLICES), pa.array(range(SLICES), pa.int32()), pa.array(list(counts.reshape(SLICES, -1)), pa.list_(pa.int64()))], names=["lang", "slice", "counts"]
        )


def train(labelled: DataFrame, text: str = "text", label: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [buckets + 1, languages]); the last row holds the priors' logarithms."""
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("string").alias("lang")).dropna()
    sums = rows.mapInArrow(_learn, "lang string, slice int, counts array<bigint>")
    merged = sums.select("lang", "slice", F.posexplode("counts").alias("at", "n")).groupBy("lang", "slice", "at").agg(F.sum("n").alias("n")).filter("n > 0")
    docs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(docs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(docs)
    at = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((BUCKETS, len(langs)))
    table = merged.groupBy("lang", "slice").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n")).collect()  # languages x slices rows
    for r in table:
        counts[r["slice"] * (BUCKETS // SLICES) + np.array(r["at"]), at[r["lang"]]] = r["n"]
    logp = np.log(counts + 0.5) - np.log(counts.sum(axis=0) + 0.5 * BUCKETS) if langs else counts
    prior = np.log(np.array([docs[x] for x in langs], float) / max(1, sum(docs.values()))) if langs else np.zeros(0)
    return langs, np.vstack([logp, prior]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *also: Column) -> DataFrame:
    """Columns `also` of docs, then lang_pred and score (the posterior probability of that language)."""
    prepare(spark := docs.sparkSession)
    langs, matrix = model
    shared = spark.sparkContext.broadcast(matrix)
    frame = docs.select(*also, F.col("text").alias("__text"))
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if langs and _has_letter(t)]
            for step in _step_of([texts[i] for i in some]):
                rows = [some[i] for i in step]
                if len(rows) == 1:
                    n = _counts(texts[rows[0]])
                    bucket = np.flatnonzero(n)
                    first, count = np.array([0, len(bucket)]), n[bucket]
                else:
                    first, bucket, count = _sparse([texts[i] for i in rows])
                joint = _joint(first, bucket, count, table)
                best = joint.argmax(1)
                weight = np.exp(joint - joint.max(1, keepdims=True))
                names[rows] = [langs[k] for k in best]
                scores[rows] = weight.max(1) / weight.sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return frame.mapInArrow(score, schema)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))
