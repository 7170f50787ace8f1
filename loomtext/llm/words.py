"""Vectorised word tokens, rolling k-grams and minimizers over Arrow string columns.

A *word* is a maximal run of ASCII digits and letters, or of code points in
U+00C0-U+1FFF, U+2C00-U+2FFF and from U+3040 on; everything else separates.
Case is folded with ``str.lower`` where this keeps a character's UTF-8 length,
so byte offsets always refer to the original text.  A null text has no words.
The whole text is read; there is no length limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The same tokens as a regular expression (RE2 and Java), to be used on lower-cased text.
WORD_RE = r"[0-9a-z\x{C0}-\x{1FFF}\x{2C00}-\x{2FFF}\x{3040}-\x{10FFFF}]+"

#: Bytes of text that are tokenised at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, so that all bits are usable."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64, at least n of them."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base & _M64, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers = (out[0], out[1])
    return _powers


@dataclass
class Words:
    """Words of a run of documents: hash, byte offsets within the document, and document borders."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def _lower(texts: pa.Array) -> pa.Array:
    low = pc.utf8_lower(texts)
    same = pc.equal(pc.binary_length(low), pc.binary_length(texts))
    if pc.all(same).as_py() in (True, None):
        return low
    out = low.to_pylist()
    for i in np.flatnonzero(~same.to_numpy(zero_copy_only=False)):
        out[i] = "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) else c for c in texts[i].as_py())
    return pa.array(out, pa.string())


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def tokenize(texts: pa.Array) -> Words:
    """Words of every text; see the module's docstring for what a word is."""
    texts = texts.fill_null("") if texts.null_count else texts
    data, off = _buffers(_lower(texts))
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(off), np.int64))
    word = _IS_WORD[data]
    if (data >= 0xC2).any():
        for at in (np.flatnonzero(data == 0xC2),):
            word[at] = False
            word[np.minimum(at + 1, n - 1)] = False
        wide = np.flatnonzero((data == 0xE2) | (data == 0xE3))
        wide = wide[wide + 2 < n]
        second = data[wide + 1]
        for j in range(3):
            word[wide[((data[wide] == 0xE2) & (second < 0xB0)) | ((data[wide] == 0xE3) & (second == 0x80))] + j] = False
    border = np.zeros(n + 1, bool)
    border[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | border[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | border[1:])) + 1
    p, inverse = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    h = mix64((total[end] - total[start]) * inverse[start] ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    ptr = np.searchsorted(start, off)
    base = np.repeat(off[:-1], np.diff(ptr))
    return Words(h, start - base, end - base, ptr)


def kgrams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and which of them stay within their document."""
    h, n = words.hash, len(words.hash)
    g = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        g[: n - j] += h[j:] * np.uint64(pow(_BASE, j + 1, 1 << 64))
    last = np.repeat(words.ptr[1:], np.diff(words.ptr))
    return mix64(g), np.arange(n) + k <= last


def minimizers(words: Words, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes and hashes of the smallest k-gram of each w neighbouring ones (leftmost of equals).

    Equal runs of w + k - 1 words share a selected k-gram at the same place.  A
    document of k to w + k - 2 words gives the smallest of all its k-grams.
    """
    g, ok = kgrams(words, k)
    n = len(g)
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (g >> bits << bits) | np.arange(n, dtype=np.uint64)
    key[~ok] = np.uint64(_M64)
    low, span = key.copy(), 1
    while span < w:
        step = min(span, w - span)
        low[: n - step] = np.minimum(low[: n - step], low[step:])
        span += step
    count = np.maximum(np.diff(words.ptr) - k + 1, 0)
    starts = np.repeat(words.ptr[:-1], np.maximum(count - w + 1, (count > 0).astype(np.int64)))
    lens = np.maximum(count - w + 1, (count > 0).astype(np.int64))
    starts = starts + np.arange(len(starts)) - np.repeat(np.cumsum(lens) - lens, lens)
    short = np.flatnonzero((count > 0) & (count < w))
    chosen = low[starts]
    if len(short):  # a window that would reach into the next document: take the document's own minimum
        place = np.searchsorted(starts, words.ptr[:-1][short])
        chosen[place] = [key[words.ptr[d] : words.ptr[d] + count[d]].min() for d in short]
    at = np.unique((chosen & np.uint64((1 << int(bits)) - 1)).astype(np.int64))
    return at, g[at]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut so that the texts of a slice hold about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            done = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last
