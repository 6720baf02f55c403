"""A corpus pipeline over `documents`: quality rules, near-duplicates, decontamination, secrets, packing.

Near-duplicates are sets of five-word shingles with a similarity of 0.8 or more; a benchmark item is found in a document
that has at least 0.8 of its five-word shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from siftwell.llm.common import materialize
from siftwell.llm.decontam import decontaminate
from siftwell.llm.neardup import drop_near_duplicates
from siftwell.llm.packing import pack_documents
from siftwell.llm.quality import quality_filter
from siftwell.llm.secrets import redact

#: No SQL has the tokenizer's ids: tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; a (lang, source) of any size has its own thresholds."""
    return quality_filter(docs, weight=50)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return drop_near_duplicates(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its token ids and its place in a sequence of 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
