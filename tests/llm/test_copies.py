"""Near-duplicates and decontamination against all pairs in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from siftwell.llm import common, decontam, neardup


def plain_set(text, k):
    return decontam.shingle_set(text, k)


def plain_components(rows, k, percent):
    rows = [(d, plain_set(t, k)) for d, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    real = [(d, s) for d, s in rows if d is not None and s]
    for i, (d, s) in enumerate(real):
        for e, t in real[:i]:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                a, b = sorted((top(d), top(e)))
                up[b] = a
    return Counter((d, len(s), top(d) if d is not None and s else d) for d, s in rows)


def got_components(frame, k, percent):
    rows = neardup.near_duplicates(frame, k, percent).collect()
    assert all(r.kept == (r.component_id == r.doc_id or r.doc_id is None) for r in rows)
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)


@pytest.fixture(scope="module")
def copies(spark):
    """Stars of near copies whose members are linked through their base only, chains, exact copies and decoys."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows, n = [], 0
    for _ in range(3):
        base = [word() for _ in range(150)]
        rows.append((n := n + 1, " ".join(base)))
        for _ in range(40):
            w = list(base)
            for at in r.sample(range(150), 3):
                w[at] = word()
            rows.append((n := n + 1, " ".join(w)))
        chain = list(base)
        for _ in range(15):
            chain[r.randrange(150)] = word()
            rows.append((n := n + 1, " ".join(chain)))
        rows += [(n := n + 1, " ".join(base).upper()), (n, " ".join(base))]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, odd_docs, copies, k, percent):
    for frame in (docs, odd_docs, copies):
        assert got_components(frame, k, percent) == plain_components([(r.doc_id, r.text) for r in frame.collect()], k, percent)
    assert neardup.near_duplicates(docs.limit(0), k, percent).count() == 0


@pytest.mark.parametrize(("leaders", "small", "size", "pairs"), [(0, 10**6, 1000, 64), (0, 1, 1000, 64), (0, 2, 10, 3), (1, 4, 10, 1)])
def test_rest_of_buckets(monkeypatch, copies, leaders, small, size, pairs):
    monkeypatch.setattr(neardup, "PAIRS", pairs)
    monkeypatch.setattr(neardup, "LEADERS", leaders)
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "TILE", size)
    assert got_components(copies, 3, 85) == plain_components([(r.doc_id, r.text) for r in copies.collect()], 3, 85)


def test_a_shared_passage_brings_no_one_together(spark):
    """A thousand texts with two thirds in common, below the threshold: no pairs, but for the one that is similar."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage, own = " ".join(word() for _ in range(80)), [" ".join(word() for _ in range(40)) for _ in range(1000)]
    rows = [(i, len({*zip(*[t.split()[j:] for j in range(3)])}), i, t) for i, t in enumerate(f"{passage} {x}" for x in [*own, own[0] + " more"])]
    met = neardup._met_by_shingle(spark.createDataFrame(rows, "rep bigint, n bigint, comp bigint, text string"), 3, 85).collect()
    assert {x.rep for x in met} == {0, 1000} and len(met) < 50


def test_drop_near_duplicates(copies, odd_docs):
    kept = neardup.drop_near_duplicates(copies, 3, 85).collect()
    want = {c for _, n, c in plain_components([(r.doc_id, r.text) for r in copies.collect()], 3, 85) if n}
    assert {r.doc_id for r in kept} == want
    odd = neardup.drop_near_duplicates(odd_docs)
    assert odd.columns == odd_docs.columns
    assert Counter(r.doc_id for r in odd.collect()) == Counter([1, 2, 3, 4, 5, None, 8, 9, 10])


def test_a_doc_id_on_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, b), (5, a), (5, b), (7, a + " z"), (7, c), (8, c + " z"), (9, c), (9, c + " y")]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "doc_id bigint, text string")
        assert sorted(map(tuple, neardup.drop_near_duplicates(frame).collect())) == [(3, b), (5, a), (7, c)]
        got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(frame).collect()}
        assert got == {(3, 3, True), (5, 5, True), (5, 3, False), (7, 5, False), (7, 7, True), (8, 7, False), (9, 7, False)}


def test_signatures_estimate_similarity():
    r = np.random.RandomState(1)
    for share in (0.3, 0.6, 0.9):
        both = r.randint(0, 1 << 62, int(2000 * share)).astype(np.uint64)
        a, b = (np.concatenate([both, r.randint(0, 1 << 62, 2000 - len(both)).astype(np.uint64)]) for _ in "ab")
        first = np.array([0, 2000, 4000])
        sig = neardup.signatures(np.concatenate([a, b]), first, 400)
        true = len(both) / (4000 - len(both))
        assert abs((sig[:, 0] == sig[:, 1]).mean() - true) < 4 * (true * (1 - true) / 400) ** 0.5


def test_word_hashes_follow_words():
    texts = ["A bc\x0bD", "", None, "d a", " bc ", "é\xa0é", "x" * 3000 + " a"]
    data, offsets = common.utf8(pa.array(texts))
    h, s, e, first = common.word_hashes(data, offsets)
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    assert [bytes(data[a:b]).lower().decode() for a, b in zip(s, e, strict=True)] == [w.lower() for x in words for w in x]
    assert np.diff(first).tolist() == [len(x) for x in words]
    flat = [w for x in words for w in x]
    assert len(set(h.tolist())) == len(set(flat)) and len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat))


def test_contained_items(spark, docs, odd_docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    items = [(100 + n, " ".join(word() for _ in range(n))) for n in (1, 2, 4, 5, 6, 9, 17, 40, 300)] + [(None, "p q r s t u v w"), (7, None), (8, " \n"), (8, " \n")]
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{filler(r.choice([0, 3, 700, 20_000]))} {t.upper()} {filler(r.choice([0, 5, 900]))}") for i, (_, t) in enumerate(items) if t]
    cut = items[7][1].split()
    rows += [(50, f"{filler(300)} {' '.join(cut[:35])} {filler(300)}"), (51, f"{filler(300)} {' '.join(cut[:20])} {filler(300)}"), (52, None), (None, items[8][1]), (53, items[2][1])]
    own = spark.createDataFrame(rows, "doc_id bigint, text string")
    mine = bench.select("item_id", "text").union(spark.createDataFrame(items, "item_id bigint, text string"))
    for frame in (docs, odd_docs, own):
        want = Counter()
        for d in frame.collect():
            s = plain_set(d.text, 5)
            for i, t in {(x.item_id, x.text) for x in mine.collect()}:
                q = plain_set(t, 5)
                if q and 100 * len(q & s) >= 80 * len(q):
                    want[(d.doc_id, i, len(q & s), len(q))] += 1
        assert Counter(map(tuple, decontam.contained_items(frame, mine).collect())) == want
    gone = {d for d, *_ in map(tuple, decontam.contained_items(own, mine).collect())}
    assert Counter(r.doc_id for r in decontam.decontaminate(own, mine).collect()) == Counter(d for d, _ in rows if d not in gone)
    assert decontam.contained_items(docs, bench.limit(0)).count() == 0 and decontam.contained_items(docs.limit(0), bench).count() == 0
