"""Suffix arrays by induced sorting.

Suffixes are classified as S or L; the leftmost S suffixes (LMS) are sorted by one pass of induction over their
substrings, named, and, where names repeat, by the suffix array of the names; a second pass induces the whole array.
Bytes are induced character by character in numpy: a bucket's entries are taken in runs, and each run puts its
predecessors, in order, at the ends of their buckets.  Names are many and their buckets short, so their strings, at every
depth of the recursion, are induced entry by entry.
"""

from __future__ import annotations

import numpy as np


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of t (bytes), in lexicographic order; an end is less than any character."""
    if len(t) < 2:
        return np.arange(len(t))
    used = np.bincount(t, minlength=256) > 0
    rank = (np.cumsum(used) - 1).astype(np.uint16)  # sorted by counting
    return _sorted(rank[t], int(used.sum()), _induced)


def _sorted(t: np.ndarray, n_chars: int, induce) -> np.ndarray:
    """The suffix array of a string of the numbers 0 .. n_chars - 1, all of which occur."""
    n = len(t)
    if n_chars == n:  # every suffix begins unlike the others
        out = np.empty(n, np.int64)
        out[t] = np.arange(n)
        return out
    s_type = _s_types(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(lms) > 1:
        order = induce(t, s_type, lms, n_chars)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        by_substring = order[is_lms[order]]
        names = _names(t, by_substring)
        at = np.empty(n, np.int64)
        at[by_substring] = names
        lms = lms[_sorted(at[lms], int(names[-1]) + 1, _induced_by_entry)]
    return induce(t, s_type, lms, n_chars)


def _s_types(t: np.ndarray) -> np.ndarray:
    n = len(t)
    differs = t[1:] != t[:-1]
    up = (t[1:] > t[:-1])[differs]
    at = np.zeros(n, np.int64)
    np.cumsum(differs, out=at[1:])
    return np.append(up, False)[at]  # the last run of characters precedes the end, which is least


def _names(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of LMS substrings (each up to the next LMS, inclusive) that are sorted already."""
    in_text = np.sort(lms)
    end = np.append(in_text[1:] + 1, len(t))[np.searchsorted(in_text, lms)]
    size = end - lms
    new = size[1:] != size[:-1]
    open_ = np.flatnonzero(~new)
    step = 0
    while len(open_):
        same = t[lms[open_] + step] == t[lms[open_ + 1] + step]
        new[open_[~same]] = True
        step += 1
        open_ = open_[same & (size[open_] > step)]
    # The last LMS substring runs to the end and is unlike any other.
    tail = np.flatnonzero(lms == in_text[-1])[0]
    new[max(tail - 1, 0) : tail + 1] = True
    return np.concatenate([[0], np.cumsum(new)])


def _induced(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, n_chars: int) -> np.ndarray:
    """The array that these LMS suffixes, in this order, induce."""
    n = len(t)
    by_char = lms[np.argsort(t[lms], kind="stable")]
    cuts = np.searchsorted(t[by_char], np.arange(n_chars + 1))
    into: list[list[np.ndarray]] = [[] for _ in range(n_chars)]

    def put(found: np.ndarray) -> None:
        of = t[found]
        order = np.argsort(of, kind="stable")
        found, of = found[order], of[order]
        ends = np.flatnonzero(np.append(of[1:] != of[:-1], True)) + 1
        at = 0
        for e in ends.tolist():
            into[of[at]].append(found[at:e])
            at = e

    into[t[n - 1]].append(np.array([n - 1]))
    large: list[np.ndarray] = []
    none = np.zeros(0, np.int64)
    for c in range(n_chars):
        run = np.concatenate(into[c]) if into[c] else none
        into[c], parts = [], []
        while len(run):
            parts.append(run)
            before = run[run > 0] - 1
            before = before[~s_type[before]]
            same = t[before] == c
            if not same.all():
                put(before[~same])
            run = before[same]
        large.append(np.concatenate(parts) if parts else none)
        here = by_char[cuts[c] : cuts[c + 1]]
        if len(here):
            put(here - 1)
    small: list[np.ndarray] = [none] * n_chars
    for c in range(n_chars - 1, -1, -1):  # from the right: runs are in descending order
        run = np.concatenate(into[c]) if into[c] else none
        into[c], parts = [], []
        while len(run):
            parts.append(run)
            before = run[run > 0] - 1
            before = before[s_type[before]]
            same = t[before] == c
            if not same.all():
                put(before[~same])
            run = before[same]
        small[c] = np.concatenate(parts)[::-1] if parts else none
        here = large[c][::-1]
        before = here[here > 0] - 1
        before = before[s_type[before]]
        if len(before):
            put(before)
    return np.concatenate([x for c in range(n_chars) for x in (large[c], small[c])])


def _induced_by_entry(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, n_chars: int) -> np.ndarray:
    """The same, one entry of the array at a time."""
    n = len(t)
    ends = np.cumsum(np.bincount(t, minlength=n_chars))
    sa = np.full(n, -1)
    of = t[lms]
    order = np.argsort(of, kind="stable")
    last = np.append(np.flatnonzero(of[order][1:] != of[order][:-1]), len(of) - 1) if len(of) else np.zeros(0, np.int64)
    behind = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(of))  # how many of the bucket come after
    sa[ends[of[order]] - 1 - behind] = lms[order]
    array = sa.tolist()
    # What precedes a suffix: its character where it is of the wanted type; the entry -1 (none yet) has none.
    before = np.append(np.append(-1, t[:-1].astype(np.int64)), -1)
    is_s = np.append(np.append(False, s_type[:-1]), False)
    of_l, of_s = np.where(is_s, -1, before).tolist(), np.where(is_s, before, -1).tolist()
    head, tail = np.append(0, ends[:-1]).tolist(), ends.tolist()
    c = int(t[n - 1])
    array[head[c]] = n - 1  # precedes the end, which is least
    head[c] += 1
    for j in array:
        c = of_l[j]
        if c >= 0:
            array[head[c]] = j - 1
            head[c] += 1
    for j in reversed(array):
        c = of_s[j]
        if c >= 0:
            tail[c] -= 1
            array[tail[c]] = j - 1
    return np.array(array)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position of t (bytes), the common prefix (at most `most`) of its suffix and the one before it in sa."""
    n = len(t)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = t
    words = np.lib.stride_tricks.as_strided(padded, (n + 1, 8), (1, 1)).copy().view("<u8").ravel()
    out = np.zeros(n, np.int32)
    i = np.flatnonzero(before >= 0)
    j = before[i]
    for d in range(0, most, 8):
        inside = np.maximum(i, j) + d < n
        i, j = i[inside], j[inside]
        if not len(i):
            break
        unlike = words[i + d] ^ words[j + d]
        some = unlike != 0
        lowest = unlike[some] & (~unlike[some] + np.uint64(1))
        out[i[some]] = d + np.log2(lowest.astype(np.float64)).astype(np.int32) // 8  # a power of two is exact
        i, j = i[~some], j[~some]
        out[i] = d + 8
    near = np.minimum(out, most)
    return np.minimum(near, np.where(before >= 0, n - np.maximum(np.arange(n), before), 0)).astype(np.int32)
