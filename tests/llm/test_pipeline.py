"""The pipeline, stage by stage, against plain versions of the stages."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from siftwell.llm import packing, repeats
from siftwell.llm.queries import QUERIES

from .conftest import SF
from .test_copies import plain_components, plain_set
from .test_texts import plain_quality, plain_secrets


def test_stages(spark, docs):
    bench = [plain_set(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in at.collect()}
        at = corpus_pipeline.materialize(stage(spark, at, SF))
        after = {r.doc_id: r for r in at.collect()}
        assert at.columns == docs.columns and len(after) == at.count()
        if name == "quality rules":
            failed = {d for d, r in before.items() if (q := plain_quality(r.text))[0] < 10 or 100 * q[4] > 20 * q[0]}
            assert not failed & set(after) and len(after) > 0.6 * len(before)
        elif name == "MinHash near-dedup":
            assert set(after) == {c for _, _, c in plain_components([(d, r.text) for d, r in before.items()], 5, 80)}
        elif name == "benchmark decontamination":
            dirty = {d for d, r in before.items() if any(q and 100 * len(q & plain_set(r.text, 5)) >= 80 * len(q) for q in bench)}
            assert dirty and set(after) == set(before) - dirty
        else:
            assert set(after) == set(before) and any("[SECRET]" in r.text for r in after.values())
            for d, r in after.items():
                assert not any(plain_secrets(r.text)[:2]) and r.n_chars == (len(r.text) if r.text != before[d].text else before[d].n_chars)
                assert any(plain_secrets(before[d].text)[:3]) or "[SECRET]" in r.text or r.text == before[d].text
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(after) and max(Counter(r.sequence_id for r in packed for _ in range(r.length)).values()) <= 2048


def test_stages_take_odd_rows(spark, odd_docs):
    at = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.materialize(stage(spark, at, SF))
    empty = odd_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert at.count() > 0


def test_columns_named_like_an_operators_own(spark, odd_docs):
    """Columns that an operator would use for itself are kept, with their values."""
    own = ["_row", "__row", "_t", "__t", "_q_kept", "_q_hi_wl", "_q_lang", "_Q_n_words", "_s_base", "_s_spans", "_s_rid"]
    marked = odd_docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in own})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got, plain = stage(spark, marked, SF), stage(spark, odd_docs, SF)
        assert got.columns == marked.columns
        rows = got.collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in plain.collect())
        assert all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for r in rows for c in own)


def test_payload_is_made(spark, docs, monkeypatch):
    """The pipeline returns the ids of its texts; the queries' digests come from the operators' ids and bytes."""
    for r in corpus_pipeline.run(spark, SF).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    made = []
    for module, name in ((packing, "pack_documents"), (repeats, "remove_repeats")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), **b: made.append(out := f(*a, **b)) or out)
    for query, column, digest in (("op8_best_fit_packing", "ids", "ids_crc32"), ("op10_suffix_array_dedup", "kept", "kept_sha256")):
        got = QUERIES[query](spark, SF)
        assert column in made[-1].columns and column not in got.columns
        assert Counter(got.select("doc_id", digest).collect()) == Counter(made[-1].select("doc_id", digest).collect())
