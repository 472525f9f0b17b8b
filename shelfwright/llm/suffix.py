"""Suffix arrays by induced sorting, in numpy, and permuted common prefixes.

Suffixes are classified as S or L; the leftmost S suffixes (LMS) are sorted by their substrings and named, their order is
that of the suffixes of the string of names, which is found in the same way unless all names differ, and the other suffixes
are induced from them. Induction goes bucket by bucket: what other buckets have induced is known when a bucket's turn comes,
runs of its own symbol follow from it in one step, and then the whole bucket induces together. Neighbouring buckets none of
which induces into another take one step together, so that a string of names, with about as many buckets as symbols, takes
some hundreds of steps and not one for each name.

Common prefixes with the suffix before are computed in text order. Where the symbols before both suffixes are the same, the
length is that of the position before less one; only the other positions are compared, and their lengths add up to
n log n at most.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes."""
    n = len(t)
    less = np.append(t[:-1] < t[1:], True)
    differs = np.append(t[:-1] != t[1:], True)
    nxt = np.where(differs, np.arange(n, dtype=np.int32), np.int32(n))
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    return less[nxt]


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before; the first does."""
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new.nonzero()[0]


class _Inducer:
    def __init__(self, t: np.ndarray, s_type: np.ndarray):
        self.t, self.s = t, s_type
        counts = np.bincount(t)
        self.tails = np.cumsum(counts)
        self.heads = self.tails - counts
        self.used = np.flatnonzero(counts)
        first = np.append(True, t[1:] != t[:-1])
        place = np.arange(len(t), dtype=np.int32)
        #: How many of the same symbol stand before each position.
        self.run_before = place - np.maximum.accumulate(np.where(first, place, 0))

    def _push(self, sa: np.ndarray, j: np.ndarray, at: np.ndarray, step: int) -> None:
        """Appends j to their buckets, in order: ``at`` is the next place of each bucket and moves by ``step``."""
        c = self.t[j]
        order = c.argsort(kind="stable")
        c = c[order]
        first = _changes(c)
        if len(first) == 1:
            k, n = int(c[0]), len(j)
            place = int(at[k])
            if step > 0:
                sa[place : place + n] = j
            else:
                sa[place - n + 1 : place + 1] = j[::-1]
            at[k] += step * n
            return
        n = np.empty_like(first)
        np.subtract(first[1:], first[:-1], out=n[:-1])
        n[-1] = len(c) - first[-1]
        own = c[first]
        # where each bucket's first goes, less its place among j
        base = at[own] - step * first
        sa[base.repeat(n) + step * np.arange(len(c))] = j[order]
        at[own] += step * n

    def _runs(self, known: np.ndarray) -> np.ndarray:
        """The suffixes that begin with more of the bucket's symbol than the known ones, in the order in which they follow."""
        n = self.run_before[known]
        if not n.any():
            return known[:0]
        back = np.arange(1, int(n.sum()) + 1) - np.repeat(np.cumsum(n) - n, n)
        return (np.repeat(known, n) - back)[np.argsort(back, kind="stable")]

    def _before(self, known: np.ndarray, s_type: bool) -> np.ndarray:
        """The suffixes one symbol longer than the known ones, of one type."""
        j = known[known > 0] - 1
        return j[self.s[j] == s_type]

    def _larger(self, sa: np.ndarray, at: np.ndarray) -> None:
        """Induces the L suffixes, buckets from the smallest on."""
        k, width = 0, 1
        while k < len(self.used):
            low, high = self.used[k], self.used[min(k + width, len(self.used)) - 1]
            known = sa[self.heads[low] : self.tails[high]]
            j = self._before(known[known >= 0], False)
            end = int(self.t[j].min()) if len(j) else high + 1
            if end == low:  # into itself
                more = self._runs(sa[self.heads[low] : at[low]])
                sa[at[low] : at[low] + len(more)] = more
                at[low] += len(more)
                end = low + 1
                known = sa[self.heads[low] : self.tails[low]]
                j = self._before(known[known >= 0], False)
                j = j[self.t[j] != low]
            else:
                end = min(end, high + 1)
                j = j[self.t[j + 1] < end]
            if len(j):
                self._push(sa, j, at, 1)
            before, k = k, int(np.searchsorted(self.used, end))
            width = (k - before) * (2 if end > high else 1)

    def _smaller(self, sa: np.ndarray, at: np.ndarray) -> None:
        """Induces the S suffixes, buckets from the largest on."""
        k, width = len(self.used) - 1, 1
        while k >= 0:
            high, low = self.used[k], self.used[max(0, k + 1 - width)]
            known = sa[self.heads[low] : self.tails[high]][::-1]
            j = self._before(known[known >= 0], True)
            end = int(self.t[j].max()) if len(j) else low - 1
            if end == high:  # into itself
                more = self._runs(sa[at[high] + 1 : self.tails[high]][::-1])
                sa[at[high] + 1 - len(more) : at[high] + 1] = more[::-1]
                at[high] -= len(more)
                end = high - 1
                known = sa[self.heads[high] : self.tails[high]][::-1]
                j = self._before(known[known >= 0], True)
                j = j[self.t[j] != high]
            else:
                end = max(end, low - 1)
                j = j[self.t[j + 1] > end]
            if len(j):
                self._push(sa, j, at, -1)
            before, k = k, int(np.searchsorted(self.used, end, "right")) - 1
            width = (before - k) * (2 if end < low else 1)

    def run(self, lms: np.ndarray) -> np.ndarray:
        """The suffix array that the LMS suffixes in this order induce."""
        sa, at = np.full(len(self.t), -1, np.int32), self.tails - 1
        self._push(sa, lms[::-1], at, -1)  # at the ends of their buckets
        at = self.heads.copy()
        self._larger(sa, at)
        sa[np.arange(len(sa)) >= np.repeat(at, self.tails - self.heads)] = -1  # but for L suffixes
        self._smaller(sa, self.tails - 1)
        sa[0] = len(self.t) - 1
        return sa


def _pack(t: np.ndarray) -> np.ndarray:
    """As many symbols from each position as make 64 bits, as one number."""
    bits = 8 * t.itemsize
    out = t.astype(np.uint64) << np.uint64(64 - bits)
    for k in range(1, 64 // bits):
        out[:-k] |= t[k:].astype(np.uint64) << np.uint64(64 - bits * (k + 1))
    return out


def _names(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The rank of each LMS substring, equal ones alike: sorted by as many symbols as make 64 bits at a time, those that tie
    again by the next. One that ends where another goes on is the larger, as its last suffix is an S and the other's an L."""
    bits, each = 8 * t.itemsize, 8 // t.itemsize
    length = np.ones(len(lms), np.int64)
    length[:-1] = np.diff(lms) + 1
    packed, rank, tied, at = _pack(t), np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while len(tied):
        rest = length[tied] - at
        fill = (np.maximum(0, each - rest) * bits).astype(np.uint64)
        key = packed[np.minimum(lms[tied] + at, len(t) - 1)] | ((np.uint64(1) << (fill & np.uint64(63))) - np.uint64(1))
        key[rest <= 0] = ~np.uint64(0)
        by = np.lexsort((key, rank[tied])) if at else key.argsort(kind="stable")
        tied, key, rest = tied[by], key[by], rest[by]
        old = rank[tied]
        new = np.append(True, (old[1:] != old[:-1]) | (key[1:] != key[:-1]))
        part, group = new.nonzero()[0], _changes(old)
        size = np.diff(np.append(part, len(tied)))
        begin = np.repeat(group, np.diff(np.append(group, len(tied))))
        rank[tied] = old + np.repeat(part, size) - begin
        tied = tied[(np.repeat(size, size) > 1) & (rest >= each)]  # one that ends just here is told from one that goes on by the next
        at += each
    return rank


def _order(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names, by the suffix array of what decides it: a name that comes once ends
    every comparison, so that names after such a name, themselves such, are left out."""
    once = np.bincount(names)[names] == 1
    left = np.flatnonzero(~once | np.append(False, ~once[:-1]))
    if not len(left):
        return np.argsort(names)
    rank = np.zeros(len(names), np.int64)
    rank[left[suffix_array(np.append(names[left] + 1, 0))[1:]]] = np.arange(len(left))
    return np.lexsort((rank, names))


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of symbols below 2^32, of which the last is 0 and no other is."""
    if len(t) < 2:
        return np.arange(len(t), dtype=np.int32)
    t = t.astype(np.uint16 if t.max() < 1 << 16 else np.uint32)
    s = _types(t)
    lms = (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(np.int32)
    return _Inducer(t, s).run(lms[_order(_names(t, lms))])


def _common(t: np.ndarray, p: int, q: int) -> int:
    n, size = 0, 64
    while True:
        x, y = t[p + n : p + n + size], t[q + n : q + n + size]
        m = min(len(x), len(y))
        differs = np.flatnonzero(x[:m] != y[:m])
        if len(differs) or not m:
            return n + (int(differs[0]) if m else 0)
        n, size = n + m, 2 * size


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, in text order, how many symbols its suffix and the one before it in the array have in common.

    The last symbol is the only 0, so two suffixes differ before either ends.
    """
    n = len(t)
    place, phi, out = np.arange(n, dtype=np.int32), np.full(n, -1, np.int32), np.zeros(n, np.int32)
    phi[sa[1:]] = sa[:-1]
    own = (phi <= 0) | (place == 0) | (t[place - 1] != t[np.maximum(phi, 1) - 1])
    packed, at, bits = _pack(t), 0, 8 * t.itemsize
    left = np.flatnonzero(own & (phi >= 0)).astype(np.int32)
    while len(left) > 32:
        x = packed[left + at] ^ packed[phi[left] + at]
        out[left] = at + sum((x < 1 << 64 - bits * k).astype(np.int32) for k in range(1, 64 // bits + 1))
        left, at = left[x == 0], at + 64 // bits
    for p in left.tolist():
        out[p] = at + _common(t, p + at, int(phi[p]) + at)
    last = np.maximum.accumulate(np.where(own, place, 0))
    return out[last] - (place - last)
