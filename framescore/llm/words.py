"""Words and k-word shingles as 64-bit hashes, made from Arrow's string buffers without Python strings.

A word is a run of characters other than the six ASCII white-space characters (``[^\\x20\\x09-\\x0D]+``). Texts
are read in blocks of about ``BLOCK`` bytes cut at white space, so a text of any length needs bounded memory
besides its own bytes and 24 bytes a word. Two different words or shingles share a hash with probability 2^-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[44, 46]] = True
_LETTER[65:91] = _LETTER[97:123] = True
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    if len(have) <= 4 * BLOCK:
        _powers[base] = have
    return have[:n]


@dataclass
class Words:
    """All words of a column. ``first[i]:first[i+1]`` are the words of row i; start and end are byte offsets in data."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _apart(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut a full stop or comma that ends a word off the ASCII letter before it."""
    tailed = _STOP[data[end - 1]] & (end - start > 1) & _LETTER[data[np.maximum(end - 2, 0)]]
    both = np.repeat(np.arange(len(start)), 1 + tailed)
    second = np.zeros(len(both), bool)
    second[1:] = both[1:] == both[:-1]
    first = tailed[both] & ~second
    return np.where(second, end[both] - 1, start[both]), np.where(first, end[both] - 1, end[both])


def _hash_block(data: np.ndarray, borders: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of one block; a word ends at each border (a text's first byte) too."""
    inner = ~_SPACE[data]
    begins, ends = inner.copy(), inner.copy()
    begins[1:] &= ~inner[:-1]
    ends[:-1] &= ~inner[1:]
    begins[borders] = inner[borders]
    before = borders[borders > 0] - 1
    ends[before] = inner[before]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if apart:
        start, end = _apart(data, start, end)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _power(_BASE, len(data)), out=sums[1:])
    raw = (sums[end] - sums[start]) * _power(_INVERSE, len(data))[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start, end


def hash_words(texts: pa.Array, apart: bool = False) -> Words:
    """The words of a string column, nulls as empty texts; ``apart`` takes closing stops and commas as words."""
    if texts.null_count:
        texts = texts.fill_null("")
    data, offsets = string_buffers(texts)
    rows_at = np.unique(offsets[:-1])
    parts, lo = [], 0
    while lo < len(data):
        hi = min(len(data), lo + BLOCK)
        while hi < len(data):
            # On to a white-space byte or the next text, whichever comes first.
            stop = np.flatnonzero(_SPACE[data[hi : hi + 4096]])
            later = rows_at[np.searchsorted(rows_at, hi) :][:1]
            at = [hi + int(stop[0])] if len(stop) else []
            at += [int(x) for x in later if x < hi + 4096]
            if at:
                hi = min(at)
                break
            hi = min(len(data), hi + 4096)
        borders = rows_at[np.searchsorted(rows_at, lo) : np.searchsorted(rows_at, hi)] - lo
        h, s, e = _hash_block(data[lo:hi], borders, apart)
        parts.append((h, s + lo, e + lo))
        lo = hi
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), data, offsets)
    hashes, start, end = (np.concatenate(x) for x in zip(*parts))
    return Words(hashes, start, end, np.searchsorted(start, offsets), data, offsets)


def shingles(words: Words, k: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of k words inside one row, and the position in ``words`` of each run's first word.

    With ``whole``, a row of 1 to k - 1 words gives one shingle of all its words; else it gives none.
    """
    h, n = words.hashes, len(words.hashes)
    odd = [np.uint64(pow(_INVERSE, j + 1, 1 << 64) | 1) for j in range(k)]
    sizes = np.diff(words.first)
    if n >= k:
        run = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            run += h[j : n - k + 1 + j] * odd[j]
        last = np.repeat(words.first[1:], sizes)[: n - k + 1]
        at = np.flatnonzero(np.arange(n - k + 1) + k <= last)
        run = mix(run[at])
    else:
        run, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if whole:
        short = np.flatnonzero((sizes > 0) & (sizes < k))
        more = np.array([sum((int(h[words.first[i] + j]) * int(odd[j]) for j in range(sizes[i])), int(sizes[i]) * 7919) & _MASK for i in short], np.uint64)
        run, at = np.concatenate([run, mix(more)]), np.concatenate([at, words.first[short]])
        order = np.argsort(at, kind="stable")
        run, at = run[order], at[order]
    return run, at


def slices(texts: pa.Array, limit: int = BLOCK):
    """Cut a column into row ranges of about ``limit`` bytes, one row at least: yields (from, to)."""
    sizes = np.diff(string_buffers(texts.fill_null("") if texts.null_count else texts)[1])
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi
