"""Suffix arrays by induced sorting, vectorised over ranges of the alphabet.

Suffixes are classified as S (smaller than their right neighbour) or L; the
leftmost S of each run (LMS) are sorted first, by sorting the LMS substrings,
naming them, and recursing on the string of names where names repeat.  The
order of all other suffixes is then induced in one scan up and one scan down
the buckets.  Where the classical scan moves from suffix to suffix, this one
moves from batch to batch of neighbouring buckets: an L suffix is placed by its
symbol, the length of the run of that symbol, and the place of the suffix after
the run, which lies in a lower bucket and so is known; S suffixes likewise from
above.  The few whose next suffix lies in their own batch are settled by
repeating the step until nothing moves.
"""

from __future__ import annotations

import numpy as np

SMALL = 64
BATCH = 1 << 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an array of numbers >= 0 in lexicographic order; a prefix goes before what extends it."""
    n = len(text)
    if n < SMALL:
        rows = text.tolist()
        return np.array(sorted(range(n), key=lambda i: rows[i:]), np.int64)
    return _sais(np.unique(text, return_inverse=True)[1].astype(np.int32))


def _runs(text: np.ndarray) -> np.ndarray:
    """Where the run of equal symbols that each position is in ends (exclusive)."""
    n = len(text)
    ends = np.full(n, n, np.int64)
    ends[:-1] = np.where(text[1:] != text[:-1], np.arange(1, n), n)
    return np.minimum.accumulate(ends[::-1])[::-1]


def _place(rank: np.ndarray, at: np.ndarray, symbol: np.ndarray, first: np.ndarray, run: np.ndarray, after: np.ndarray, low: int, up: bool) -> None:
    """Ranks of a batch's suffixes of one type; ``first`` is where each one's symbol has its places."""
    r = run if up else run.max() - run
    rbits, nbits = int(r.max()).bit_length(), (len(rank) + 1).bit_length()
    symbol = symbol - symbol[0]
    inside = rank[after] == -2
    begin = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
    within = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    rank[at] = first  # to begin with, all at their bucket's first place
    while True:
        next_ = rank[after] + 1
        if int(symbol[-1]).bit_length() + rbits + nbits < 63:
            order = np.argsort((symbol.astype(np.int64) << (rbits + nbits)) | (r.astype(np.int64) << nbits) | next_)
        else:
            order = np.lexsort((next_, r, symbol))
        new = np.empty(len(at), np.int64)
        new[order] = first + within  # symbols are in order already, so places go with them
        moved = inside.any() and (new != rank[at]).any()
        rank[at] = new
        if not moved:
            return


def _batches(symbol: np.ndarray) -> list[tuple[int, int]]:
    """Slices of whole buckets of about BATCH suffixes."""
    n, cuts = len(symbol), [0]
    borders = np.append(np.flatnonzero(symbol[1:] != symbol[:-1]) + 1, n)
    while cuts[-1] < n:
        cuts.append(int(borders[min(np.searchsorted(borders, cuts[-1] + BATCH), len(borders) - 1)]))
    return list(zip(cuts[:-1], cuts[1:]))


def _induce(text: np.ndarray, is_s: np.ndarray, bounds: np.ndarray, runs: np.ndarray, types: tuple[np.ndarray, np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """From the LMS suffixes in order (or any order, for that of their substrings) to the rank of each suffix."""
    n = len(text)
    rank = np.full(n + 1, -2, np.int64)
    rank[n] = -1  # the empty suffix is smaller than all
    symbol = text[seeds]
    count = np.bincount(symbol, minlength=len(bounds) - 1)
    order = np.argsort(symbol, kind="stable")
    within = np.arange(len(seeds)) - np.repeat(np.cumsum(count) - count, count)
    rank[seeds[order]] = np.repeat(bounds[1:] - count, count) + within
    up, down = types
    symbol = text[up]
    for a, b in _batches(symbol):
        at, c = up[a:b], symbol[a:b]
        _place(rank, at, c, bounds[c], runs[at] - at, runs[at], a, True)
    rank[seeds] = -2
    symbol = text[down]
    tail = bounds[1:] - np.bincount(symbol, minlength=len(bounds) - 1)
    for a, b in reversed(_batches(symbol)):
        at, c = down[a:b], symbol[a:b]
        _place(rank, at, c, tail[c], runs[at] - at, runs[at], a, False)
    return rank[:n]


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; equal neighbours take the type of the run's end."""
    n = len(text)
    up = np.zeros(n, np.int8)
    up[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    settled = np.where(up != 0, np.arange(n), n - 1)
    settled[n - 1] = n - 1
    nearest = np.minimum.accumulate(settled[::-1])[::-1]
    up[n - 1] = -1  # the last suffix is followed by the empty one
    return up[nearest] > 0


def _sais(text: np.ndarray) -> np.ndarray:
    n = len(text)
    is_s = _types(text)
    lms = np.flatnonzero(is_s & ~np.concatenate(([True], is_s[:-1])))
    bounds = np.concatenate(([0], np.cumsum(np.bincount(text))))
    runs = _runs(text)
    by_symbol = np.argsort(text, kind="stable")
    types = (by_symbol[~is_s[by_symbol]], by_symbol[is_s[by_symbol]])
    order = lms
    if len(lms) > 1:
        rank = _induce(text, is_s, bounds, runs, types, lms)
        order = lms[np.argsort(rank[lms])]
        # LMS substrings are now in order; equal ones get equal names
        which = np.searchsorted(lms, order)
        length = np.append(np.diff(lms) + 1, n - lms[-1] + 1)  # the last one ends with the text and equals no other
        a, b, size = order[:-1], order[1:], length[which[:-1]]
        same = (size == length[which[1:]]) & (which[:-1] != len(lms) - 1) & (which[1:] != len(lms) - 1)
        live, k = np.flatnonzero(same), 0
        while len(live):
            equal = text[a[live] + k] == text[b[live] + k]
            same[live[~equal]] = False
            k += 1
            live = live[equal]
            live = live[size[live] > k]
        names = np.concatenate(([0], np.cumsum(~same)))
        if names[-1] + 1 < len(lms):
            reduced = np.empty(len(lms), np.int64)
            reduced[which] = names
            order = lms[suffix_array(reduced)]
    rank = _induce(text, is_s, bounds, runs, types, order)
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted: for each text position, the common prefix of its suffix and the one before it in the array.

    A position whose suffix and the one before it both continue a pair of
    neighbours with the same symbol has one less than the position before it
    (reducible); only the others are compared symbol by symbol, all at once.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    pos = np.arange(n)
    before = np.where(phi > 0, text[np.maximum(phi, 1) - 1], -1)
    reducible = np.zeros(n, bool)
    reducible[1:] = (phi[1:] > 0) & (before[1:] == text[:-1])
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(~reducible & (phi >= 0))
    k = 0
    padded = np.append(text.astype(np.int64), [-1])
    while len(live):
        i, j = live + k, phi[live] + k
        equal = (i < n) & (j < n) & (padded[np.minimum(i, n)] == padded[np.minimum(j, n)])
        live = live[equal]
        out[live] += 1
        k += 1
    start = np.maximum.accumulate(np.where(~reducible, pos, 0))
    return np.where(reducible, np.maximum(out[start] - (pos - start), 0), out)
