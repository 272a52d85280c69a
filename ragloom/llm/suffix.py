"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def _induce(t: list[int], larger: list[bool], sa: list[int], head: list[int], tail: list[int]) -> None:
    """Sorts from the leftmost-smaller suffixes in sa first those of the larger type, then those of the smaller."""
    at = head.copy()
    for i in range(len(sa)):
        j = sa[i] - 1
        if j >= 0 and larger[j]:
            c = t[j]
            sa[at[c]] = j
            at[c] += 1
    at = tail.copy()
    for i in range(len(sa) - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and not larger[j]:
            c = t[j]
            at[c] -= 1
            sa[at[c]] = j


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of t, whose last symbol must be 0 and occur nowhere else; linear time in len(t).

    Suffixes are classified as larger or smaller than the next; substrings between
    leftmost-smaller positions are sorted by induction and named; where two have a
    name in common the names are sorted recursively; the whole order is induced from that.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    sigma = int(t.max()) + 1
    # Larger type: t[i] > t[i+1], or equal and the next is of the larger type. The type of a run is that of its end.
    differ = np.flatnonzero(t[:-1] != t[1:])
    nxt = differ[np.searchsorted(differ, np.arange(n - 1))]
    larger = np.append(t[nxt] > t[nxt + 1], False)
    first = np.flatnonzero(larger[:-1] & ~larger[1:]) + 1  # leftmost-smaller positions
    tail = np.cumsum(np.bincount(t, minlength=sigma))
    head = np.concatenate([[0], tail[:-1]])
    seq, types, heads, tails = t.tolist(), larger.tolist(), head.tolist(), tail.tolist()

    def place(order: np.ndarray) -> list[int]:
        """The positions given, in their order, at the ends of their buckets."""
        sa = np.full(n, -1, np.int64)
        symbol = t[order]
        by = np.argsort(symbol, kind="stable")
        symbol = symbol[by]
        start = np.concatenate([[0], np.flatnonzero(np.diff(symbol)) + 1])
        size = np.diff(np.append(start, len(symbol)))
        rank = np.arange(len(symbol)) - np.repeat(start, size)
        sa[tail[symbol] - np.repeat(size, size) + rank] = order[by]
        return sa.tolist()

    sa = place(first)
    _induce(seq, types, sa, heads, tails)
    if len(first) > 1:
        is_first = np.zeros(n, bool)
        is_first[first] = True
        got = np.array(sa)
        order = got[is_first[got]]
        # Two neighbours in this order have one name if their substrings are equal.
        end = np.full(n, n - 1, np.int64)
        end[first[:-1]] = first[1:]
        length = end[order] - order + 1
        same = np.zeros(len(order), bool)
        near = np.flatnonzero(length[1:] == length[:-1])
        a, b, left = order[near], order[near + 1], length[near]
        k = 0
        while len(near):
            equal = t[a + k] == t[b + k]
            near, a, b, left = near[equal], a[equal], b[equal], left[equal]
            k += 1
            whole = left == k
            same[near[whole] + 1] = True
            near, a, b, left = near[~whole], a[~whole], b[~whole], left[~whole]
        same[length == 1] = False  # the last symbol alone
        name_of = np.cumsum(~same) - 1
        names = np.empty(n, np.int64)
        names[order] = name_of
        reduced = names[first]
        order = first[suffix_array(reduced)] if name_of[-1] + 1 < len(first) else order
        sa = place(order)
        _induce(seq, types, sa, heads, tails)
    return np.array(sa, np.int64)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, unique_from: int) -> np.ndarray:
    """For each position in text order the common prefix of its suffix and the one before it in sa.

    As a suffix loses its first symbol the value falls by one at most, so the
    comparisons are linear in all. Symbols from unique_from on equal none.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    seq, phi = t.tolist(), before.tolist()
    out = [0] * n
    same = 0
    for i in range(n):
        j = phi[i]
        if j < 0:
            same = 0
            continue
        top = n - max(i, j)
        while same < top and seq[i + same] == seq[j + same] and seq[i + same] < unique_from:
            same += 1
        out[i] = same
        if same:
            same -= 1
    return np.array(out, np.int64)
