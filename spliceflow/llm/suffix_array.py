"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller or larger than their right neighbour; the leftmost-smaller (LMS)
substrings are sorted by one induction, named, and sorted recursively through the string of their
names; a second induction derives the whole array in linear time. Bytes have few buckets, so there
an induction handles a bucket's suffixes at once; the strings of names have many, and go one by one.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced a bucket at a time.
SMALL = 300


def classify(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smaller-type flags, LMS positions) of s, whose last element is its unique least."""
    n = len(s)
    up = np.zeros(n, bool)
    up[-1] = True
    step = np.sign(s[1:].astype(np.int64) - s[:-1].astype(np.int64))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    up[:-1] = (nxt < n - 1) & (step[np.minimum(nxt, n - 2)] > 0)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    return up, lms


def _bounds(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(s, minlength=k)
    end = np.cumsum(count)
    return end - count, end


def _put(sa: np.ndarray, where: np.ndarray, chars: np.ndarray, items: np.ndarray, down: bool) -> None:
    """Append items to their characters' buckets, in order, upwards from or downwards below ``where``."""
    if not len(items):
        return
    order = np.argsort(chars, kind="stable")
    c, v = chars[order], items[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    size = np.diff(np.r_[first, len(c)])
    nth = np.arange(len(c)) - np.repeat(first, size)
    base = np.repeat(where[c[first]], size)
    if down:
        sa[base - 1 - nth] = v
        where[c[first]] -= size
    else:
        sa[base + nth] = v
        where[c[first]] += size


def _induce_buckets(s: np.ndarray, up: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    start, end = _bounds(s, k)
    sa = np.full(len(s), -1, np.int64)
    small = s.astype(np.uint16)
    tail = end.copy()
    _put(sa, tail, small[seeds[::-1]], seeds[::-1], down=True)
    head, seeded = start.copy(), tail.copy()
    for c in range(k):
        i = start[c]
        while i < head[c]:
            block, i = sa[i : head[c]], head[c]
            j = block[block > 0] - 1
            j = j[~up[j]]
            _put(sa, head, small[j], j, down=False)
        block = sa[seeded[c] : end[c]]
        j = block[block > 0] - 1
        j = j[~up[j]]
        _put(sa, head, small[j], j, down=False)
    # The seeds give way to the smaller-type suffixes in their final order.
    tail = end.copy()
    for c in range(k - 1, -1, -1):
        i = end[c]
        while i > tail[c]:
            block, i = sa[tail[c] : i][::-1].copy(), tail[c]
            j = block[block > 0] - 1
            j = j[up[j]]
            _put(sa, tail, small[j], j, down=True)
        block = sa[start[c] : head[c]][::-1]
        j = block[block > 0] - 1
        j = j[up[j]]
        _put(sa, tail, small[j], j, down=True)
    sa[0] = len(s) - 1
    return sa


def _induce_one_by_one(s: np.ndarray, up: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    start, end = _bounds(s, k)
    text, kind = s.tolist(), up.tolist()
    sa = [-1] * len(text)
    tail = end.tolist()
    for p in seeds[::-1].tolist():
        c = text[p]
        tail[c] -= 1
        sa[tail[c]] = p
    head = start.tolist()
    for p in sa:  # grows to the right while it is read
        if p > 0 and not kind[p - 1]:
            c = text[p - 1]
            sa[head[c]] = p - 1
            head[c] += 1
    tail = end.tolist()
    for i in range(len(sa) - 1, -1, -1):
        p = sa[i]
        if p > 0 and kind[p - 1]:
            c = text[p - 1]
            tail[c] -= 1
            sa[tail[c]] = p - 1
    sa[0] = len(text) - 1
    return np.array(sa, np.int64)


def _names(s: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in order of position; equal substrings share one."""
    n = len(s)
    size = np.empty(n + 1, np.int64)
    size[lms] = np.diff(np.r_[lms, n - 1]) + 1
    a, b = ranked[:-1], ranked[1:]
    same = size[a] == size[b]
    live, off = np.flatnonzero(same), 0
    while len(live):
        x, y = a[live] + off, b[live] + off
        bad = s[x] != s[y]
        same[live[bad]] = False
        off += 1
        live = live[~bad & (size[a[live]] > off)]
    name = np.empty(n, np.int64)
    name[ranked] = np.r_[0, np.cumsum(~same)]
    return name[lms], int(name[ranked[-1]]) + 1


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of integers 0 <= s < k whose last element is the unique least."""
    if len(s) <= 2:
        return np.arange(len(s))[::-1].copy()
    induce = _induce_buckets if k <= SMALL else _induce_one_by_one
    up, lms = classify(s)
    first = induce(s, up, lms, k)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    ranked = first[is_lms[first]]
    name, count = _names(s, lms, ranked)
    if count == len(lms):
        order = ranked
    else:
        order = lms[suffix_array(name, count)]
    return induce(s, up, order, k)


def common_prefixes(data: np.ndarray, sa: np.ndarray, ok: np.ndarray, length: int) -> np.ndarray:
    """Positions p of ``data`` (bytes) with ``ok`` whose ``length`` bytes also start at a neighbour in the array.

    Prefixes are taken in text order against each suffix's predecessor in the array and cut at ``length``.
    """
    before = np.full(len(data), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    live = np.flatnonzero(ok & (before >= 0))
    live = live[ok[before[live]]]
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    for off in [*range(0, length - 8, 8), length - 8]:
        x = words[live + off].view(np.uint64).ravel()
        y = words[before[live] + off].view(np.uint64).ravel()
        live = live[x == y]
    out = np.zeros(len(data), bool)
    out[live] = True
    out[before[live]] = True
    return out
