"""Suffix arrays and repeated strings against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from siftwell.llm import repeats, suffixes


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array(seed):
    r = random.Random(seed)
    n = r.choice([0, 1, 2, 3, 7, 40, 400])
    t = bytes(r.choice([b"a", b"ab", b"abc", bytes(range(200))][r.randrange(4)]) for _ in range(n))
    if seed % 3 == 0:
        t = t[: n // 3] * 3
    sa = suffixes.suffix_array(np.frombuffer(t, np.uint8))
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    plcp = suffixes.permuted_lcp(np.frombuffer(t, np.uint8), sa, 50)
    for a, b in zip(sa.tolist(), sa[1:].tolist()):
        k = 0
        while k < 50 and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        assert plcp[b] == k


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_of_texts(seed):
    """Long enough for several levels of recursion with many thousands of names."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    passages = [" ".join(r.choice(words) for _ in range(40)) for _ in range(30)]
    t = "\n".join(r.choice([*passages, " ".join(r.choice(words) for _ in range(60))]) for _ in range(150)).encode()
    sa = suffixes.suffix_array(np.frombuffer(t, np.uint8))
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_induction_by_entry_is_that_by_character():
    r = np.random.RandomState(1)
    for n in (2, 3, 10, 200, 3000):
        for k in (1, 2, 5, 40):
            t = np.unique(r.randint(0, k, n), return_inverse=True)[1].astype(np.uint16)
            s_type = suffixes._s_types(t)
            lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
            r.shuffle(lms)
            assert (suffixes._induced(t, s_type, lms, t.max() + 1) == suffixes._induced_by_entry(t, s_type, lms, t.max() + 1)).all()


def plain(rows, size=50):
    first = {}
    rows = [(d, (t or "").encode()) for d, t in rows]
    for d, b in rows:
        for i in range(len(b) - size + 1 if d is not None else 0):
            g = b[i : i + size]
            first[g] = min(first.get(g, d), d)
    out = Counter()
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1 if d is not None else 0):
            if first[b[i : i + size]] < d:
                gone[i : i + size] = b"\1" * size
        spans = bytes(gone).replace(b"\0", b" ").split()
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[(d, len(b), sum(gone), len(spans), hashlib.sha256(left).hexdigest())] += 1
    return out


@pytest.fixture(scope="module")
def passages(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(1, 6)))
    shared = ["".join(word() for _ in range(r.randint(5, 60))) for _ in range(8)] + ["a" * 300, "ab" * 70]
    rows = []
    for i in range(120):
        rows.append((r.randrange(10**6), "".join(r.choice(["".join(word() for _ in range(r.randint(0, 40))), *shared]) for _ in range(r.randint(0, 8)))))
    rows += rows[:5] + [(d + 10**7, t) for d, t in rows[5:15]] + [(-3, shared[0][:50]), (10**8, shared[0][:50]), (10**8 + 1, shared[0][:49])]
    return spark.createDataFrame(list({d: (d, t) for d, t in rows}.values()) + rows[:3], "doc_id bigint, text string")


def test_repeats(docs, odd_docs, passages):
    for frame in (docs, odd_docs, passages):
        want = plain([(r.doc_id, r.text) for r in frame.collect()])
        got = repeats.remove_repeats(frame).collect()
        assert Counter(tuple(r)[:5] for r in got) == want
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
