"""Suffix arrays by induced sorting (Nong, Zhang and Chan, 2009) and permuted common prefixes, on numpy arrays.

Induction goes bucket by bucket: what a bucket holds so far induces its predecessors at once, so a pass is a few array
operations per character and run length, and linear in the text. Names of leftmost-smaller (LMS) substrings form the
shorter text, which is sorted by naming pairs of names again and again, as its alphabet is too large for buckets.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S type); the last one, the sentinel, is."""
    n = len(s)
    change = np.append(np.flatnonzero(s[1:] != s[:-1]), n - 1)
    at = np.repeat(change, np.diff(np.append(-1, change)))
    rises = np.append(s[1:] > s[:-1], True)
    return rises[at]


def _place(sa: np.ndarray, items: np.ndarray, chars: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Put items, in order, at the open edge of their buckets."""
    order = np.argsort(chars, kind="stable")
    chars, items = chars[order], items[order]
    new = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
    counts = np.diff(np.append(new, len(chars)))
    rank = np.arange(len(chars)) - np.repeat(new, counts)
    sa[edge[chars] + step * rank] = items
    edge[chars[new]] += step * counts


def _induce(s: np.ndarray, lms: np.ndarray, small: np.ndarray) -> np.ndarray:
    """The suffix array that sorted LMS suffixes induce (of unsorted ones: their substrings are sorted)."""
    counts = np.bincount(s)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(len(s), -1, np.int64)
    lms_counts = np.bincount(s[lms], minlength=len(counts))
    edge = ends - lms_counts
    _place(sa, lms, s[lms], edge, 1)
    head = starts.copy()
    present = np.flatnonzero(counts).tolist()

    def push(items, wanted, edge, step):
        before = items[items > 0] - 1
        before = before[small[before] == wanted]
        if len(before):
            _place(sa, before, s[before], edge, step)

    for c in present:
        done = starts[c]
        while done < head[c]:
            items, done = sa[done : head[c]].copy(), head[c]
            push(items, False, head, 1)
        if lms_counts[c]:
            push(sa[ends[c] - lms_counts[c] : ends[c]], False, head, 1)
    tail = ends - 1
    tail[s[-1]] -= 1  # the sentinel stays
    for c in reversed(present):
        done = ends[c] - 1
        while done > tail[c]:
            items, done = sa[tail[c] + 1 : done + 1][::-1].copy(), tail[c]
            push(items, True, tail, -1)
        if head[c] > starts[c]:
            push(sa[starts[c] : head[c]][::-1], True, tail, -1)
    return sa


def _names(s: np.ndarray, sorted_lms: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Name of each LMS substring in text order: equal substrings have equal names, names go up with the order."""
    n, m = len(s), len(lms)
    index = np.empty(n, np.int64)
    index[lms] = np.arange(m)
    last = np.append(lms[1:], n - 1)
    a, b = sorted_lms[:-1], sorted_lms[1:]
    size_a, size_b = last[index[a]] - a, last[index[b]] - b
    same = size_a == size_b
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        equal = s[a[open_] + k] == s[b[open_] + k]
        same[open_[~equal]] = False
        open_ = open_[equal & (size_a[open_] > k)]
        k += 1
    names = np.empty(m, np.int64)
    names[index[sorted_lms]] = np.cumsum(np.concatenate([[0], ~same]))
    return names


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the text of names; its last name is unique."""
    m = len(names)
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rank = np.empty(m, np.int64)
    # A rank is where the group of equal suffixes begins in the order.
    rank[order] = np.repeat(first, np.diff(np.append(first, m)))
    sizes = np.diff(np.append(first, m))
    tied = order[np.repeat(sizes > 1, sizes)]
    step = 1
    while len(tied):
        after = np.where(tied + step < m, rank[np.minimum(tied + step, m - 1)] + 1, 0)
        key = rank[tied] * (m + 1) + after
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        group = rank[tied]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.maximum.accumulate(np.where(new_group, np.arange(len(tied)), 0))
        place = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
        rank[tied] = group + place - begin
        sizes = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
        step *= 2
    out = np.empty(m, np.int64)
    out[rank] = np.arange(m)
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of s in order. s: whole numbers, the last one less than all others and unique."""
    if len(s) < 2:
        return np.arange(len(s))
    s = s.astype(np.int64) if s.max() >= 1 << 16 else s.astype(np.uint16)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    sa = _induce(s, lms, small)
    sorted_lms = sa[is_lms[sa]]
    order = _sort_names(_names(s, sorted_lms, lms))
    return _induce(s, lms[order], small)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position of s: length of the common prefix with the suffix before it in the order, and that suffix.

    Only positions whose left neighbours differ are compared (irreducible ones); every other value is one less than
    the value to its left.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    at = np.arange(n)
    left = np.maximum(before - 1, 0)
    reducible = (at > 0) & (before > 0) & (s[at - 1] == s[left])
    own = np.flatnonzero(~reducible & (before >= 0))
    value = np.zeros(n, np.int64)
    # Four values of 16 bits at a time, then one by one.
    data = np.concatenate([s.astype("<u2"), np.zeros(8, "<u2")])
    eight = np.ndarray((n + 4,), "<u8", data.tobytes(), strides=(2,))
    open_, length = own, np.zeros(n, np.int64)
    while len(open_):
        a, b = open_ + length[open_], before[open_] + length[open_]
        fits = np.maximum(a, b) + 4 <= n
        same = fits & (eight[np.minimum(a, n)] == eight[np.minimum(b, n)])
        length[open_[same]] += 4
        open_ = open_[same]
    open_ = own
    while len(open_):
        a, b = open_ + length[open_], before[open_] + length[open_]
        same = (np.maximum(a, b) < n) & (data[np.minimum(a, n)] == data[np.minimum(b, n)])
        length[open_[same]] += 1
        open_ = open_[same]
    value[own] = length[own]
    # Forward: value at the last compared position less the distance to it.
    anchor = np.maximum.accumulate(np.where(~reducible, at, 0))
    return value[anchor] - (at - anchor), before
