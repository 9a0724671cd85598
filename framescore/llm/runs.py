"""Operator 13: periodic runs of words by online dyadic square catching.

A run is a stretch of words with smallest period q that is at least ``max(LEAST_WORDS, TIMES * q)`` long and goes on in neither
direction with period q.

Words are appended; ``Catcher.append`` takes any number of them at once, and the runs do not depend on how a text is cut.
When a block of 2^j words (from a multiple of 2^j) is complete, it gets a catcher. That of level j looks out for squares of periods
2^j to 2^(j+1) - 1; the lowest one, of 2^3 words, for all periods below 16. It waits for a suffix of the text that equals its block at such a
distance: the comparisons of all suffixes that fall due in an append are one comparison of arrays per level, so a text of n
words costs n comparisons in each of log2 n levels. A caught pair is a square in the making: its comparison goes on word by
word, backwards once and forwards with each append, and while it holds, the square is part of one stretch, which later squares of that
period only extend. A stretch whose period is not its smallest one, or that ends too short, is no run.

No run is missed: a run of period q in 2^j to 2^(j+1) - 1 and 3q words or more has a whole block of 2^j words in its first 2q, and
that block again q words later; one of period below 8 and 24 words or more has a whole block of 8 words in its first 15. A pair of level j
inside a known stretch whose period divides the pair's distance belongs to that stretch.

Words are compared by 64-bit hashes. Defined cases: null and blank texts have no words and no runs; rows of equal doc_id are texts of
their own; an empty table gives no rows; columns of other names are not read. One text is worked on in one task, in memory
of about 60 bytes a word.
"""

from __future__ import annotations

from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescore.llm.words import hash_words, mix, slices

LEAST_WORDS, TIMES = 24, 3
# The lowest level's blocks have 2^LOW words.
LOW = 3
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def _agreeing(words: np.ndarray, i: int, j: int, step: int, limit: int) -> int:
    """How many words agree from places i and j on, in direction ``step``, ``limit`` at most; read in growing pieces."""
    done, size = 0, 32
    while done < limit:
        n = min(size, limit - done)
        if step > 0:
            differ = np.flatnonzero(words[i + done : i + done + n] != words[j + done : j + done + n])
        else:
            differ = np.flatnonzero(words[i - done - n + 1 : i - done + 1][::-1] != words[j - done - n + 1 : j - done + 1][::-1])
        if len(differ):
            return done + int(differ[0])
        done, size = done + n, 2 * size
    return done


class Catcher:
    """Finds the runs of a growing sequence of hashed words.

    ``longest`` is the greatest length a stretch can have, if it is known: levels beyond a third of it are left out.
    """

    def __init__(self, least: int = LEAST_WORDS, times: int = TIMES, longest: int | None = None):
        # The lowest level's blocks are found in all runs of three periods and 24 words.
        if least < 3 * 2**LOW or times < 3:
            raise ValueError("runs of fewer than 24 words or 3 periods are not caught")
        self.least, self.times, self.longest = least, times, longest
        self.n, self._words = 0, np.zeros(64, np.uint64)
        # Sums of words times powers of an odd number, and the inverse powers: the hash of any words in a row is a difference.
        self._sums, self._scale = np.zeros(65, np.uint64), np.ones(65, np.uint64)
        # Stretches (start, end, period) that hold so far at the end of the text, and runs that are over.
        self._open: set[tuple[int, int, int]] = set()
        self._over: set[tuple[int, int, int]] = set()

    def append(self, words: np.ndarray) -> None:
        """Take further words: advance what is open, then every comparison of a block with a suffix that falls due."""
        before, n = self.n, self.n + len(words)
        self._grow(words)
        self._open = {(a, b + _agreeing(self._words, b, b - q, 1, n - b), q) for a, b, q in self._open}
        self._close()
        level = LOW
        while 2 * 2**level <= n and (self.longest is None or level == LOW or 3 * 2**level <= self.longest):
            self._catch(2**level, *self._due(level, before, n))
            level += 1

    def _grow(self, words: np.ndarray) -> None:
        before, n = self.n, self.n + len(words)
        if n > len(self._words):
            size = max(n, 2 * len(self._words))
            for name, more in (("_words", 0), ("_sums", 1), ("_scale", 1)):
                old = getattr(self, name)
                grown = np.zeros(size + more, np.uint64)
                grown[: len(old)] = old
                setattr(self, name, grown)
            self._scale[0] = 1
            self._scale[1:] = np.multiply.accumulate(np.full(size, _INVERSE, np.uint64))
        elif before == 0:
            self._scale[1:] = np.multiply.accumulate(np.full(len(self._words), _INVERSE, np.uint64))
        self._words[before:n] = words
        powers = np.multiply.accumulate(np.full(len(words), _ODD, np.uint64)) * np.uint64(pow(_ODD, before, 1 << 64))
        self._sums[before + 1 : n + 1] = np.cumsum(words * powers) + self._sums[before]
        self.n = n

    def _due(self, level: int, before: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(block start, distance) of the suffixes that end in words before to n - 1 and have the hash of a block that waits for them."""
        size = 2**level
        # A suffix begins at p; blocks wait for it from the whole block before its own on.
        first = max(before - size + 1, 0)
        lo = max(first // size - 1, 0) * size
        hashes = (self._sums[lo + size : n + 1] - self._sums[lo : n - size + 1]) * self._scale[lo : n - size + 1]
        p = np.arange(first, n - size + 1)
        own = p // size * size
        at = own - size
        same = (at >= 0) & (hashes[p - lo] == hashes[np.maximum(at - lo, 0)])
        if level > LOW:
            return at[same], (p - at)[same]
        # Shorter periods: the block that the suffix begins in.
        near = (own < p) & (hashes[p - lo] == hashes[own - lo])
        at, d = np.concatenate([at[same], own[near]]), np.concatenate([(p - at)[same], (p - own)[near]])
        order = np.lexsort((d, at))
        return at[order], d[order]

    def _catch(self, size: int, at: np.ndarray, d: np.ndarray) -> None:
        """Follow the squares of caught pairs; a pair inside a known stretch that explains it is dropped."""
        if len(at) == 0:
            return
        known = sorted(self._over | self._open)
        if known:
            # The last known stretch that begins at or before the block.
            starts, ends, periods = (np.array(x) for x in zip(*known))
            i = np.maximum(np.searchsorted(starts, at, side="right") - 1, 0)
            explained = (at >= starts[i]) & (at + d + size <= ends[i]) & (d % periods[i] == 0)
            at, d = at[~explained], d[~explained]
        while len(at):
            s, q = int(at[0]), int(d[0])
            end = s + q + _agreeing(self._words, s + q, s, 1, self.n - s - q)
            explained = np.zeros(len(at), bool)
            explained[0] = True
            if end - s - q >= size:
                start = s - _agreeing(self._words, s - 1, s + q - 1, -1, s)
                q = self._smallest(start, end, q)
                self._open.add((start, end, q))
                explained |= (at >= start) & (at + d + size <= end) & (d % q == 0)
            at, d = at[~explained], d[~explained]
        self._close()

    def _smallest(self, start: int, end: int, period: int) -> int:
        """The smallest period of a stretch of two periods at least: it divides every other one."""
        words = self._words[start:end]
        for p in _prime_factors(period):
            while period % p == 0 and np.array_equal(words[: -(period // p)], words[period // p :]):
                period //= p
        return period

    def _close(self) -> None:
        """Put away the stretches that the last word does not belong to; only runs are kept of them."""
        over = {s for s in self._open if s[1] < self.n}
        self._open -= over
        self._over |= {s for s in over if self._long(*s)}

    def _long(self, start: int, end: int, period: int) -> bool:
        return end - start >= max(self.least, self.times * period)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs of the words so far, by start, then period."""
        return sorted((a, b - a, q) for a, b, q in self._over | self._open if self._long(a, b, q))


def runs_of_rows(hashes: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs of each of many texts, ``first[i]:first[i+1]`` being the words of text i, all sent through one catcher.

    A word that occurs nowhere else stands between two texts, so no stretch crosses them.
    """
    n_rows = len(first) - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n_rows)]
    if not len(hashes):
        return out
    row = np.repeat(np.arange(n_rows), np.diff(first))
    stream = np.zeros(len(hashes) + n_rows, np.uint64)
    stream[np.arange(len(hashes)) + row] = hashes
    stream[first[1:] + np.arange(n_rows)] = mix(np.arange(1, n_rows + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    catcher = Catcher(longest=int(np.diff(first).max()))
    catcher.append(stream)
    begins = first[:-1] + np.arange(n_rows)
    for start, length, period in catcher.runs():
        i = int(np.searchsorted(begins, start, side="right")) - 1
        out[i].append((start - int(begins[i]), length, period))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if each run is cut to its first period."""
    kept = np.ones(n, bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return kept


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period): one row per run of each text."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(texts):
                words = hash_words(texts.slice(lo, hi - lo))
                found = runs_of_rows(words.hashes, words.first)
                row = [i for i, own in enumerate(found) for _ in own]
                flat = [r for own in found for r in own]
                columns = [pa.array([r[c] for r in flat], pa.int64()) for c in range(3)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(row, pa.int64())), *columns], ["doc_id", "start", "length", "period"])

    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, start bigint, length bigint, period bigint")


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with every run cut to its first period, words joined by one space; texts without a run stay as they are."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            texts = batch.column(0)
            parts = []
            for lo, hi in slices(texts):
                own = texts.slice(lo, hi - lo)
                words = hash_words(own)
                for i, (found, text) in enumerate(zip(runs_of_rows(words.hashes, words.first), own.to_pylist())):
                    if found:
                        kept = kept_words(int(words.first[i + 1] - words.first[i]), found)
                        text = b" ".join(w for w, k in zip(text.encode().split(), kept) if k).decode()
                    parts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), *batch.columns[1:]], ["text", *names])

    rows = docs.select(F.col("text").cast("string"), *names)
    return rows.mapInArrow(run, rows.schema).select(*docs.columns)


def _periodic(n: int, h: int) -> np.ndarray:
    """The original word at each of n places after some words were made periodic, as the crc32 of the doc_id tells."""
    at = np.arange(n)
    if h % 10 or n == 0:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(at < a, at, a + (at - a) % p)


RUN_DIGESTS = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
)


def digests(docs: DataFrame) -> DataFrame:
    """``RUN_DIGESTS``, one row per document: its runs after every tenth text or so (by crc32 of the doc_id) was made periodic.

    A null doc_id counts as one whose text is left as it is.
    """

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(texts):
                own = texts.slice(lo, hi - lo)
                words = hash_words(own)
                docs_of, first = ids.slice(lo, hi - lo).to_pylist(), words.first.tolist()
                order = [_periodic(first[i + 1] - first[i], 1 if doc is None else crc32(str(doc).encode())) for i, doc in enumerate(docs_of)]
                place = np.concatenate([o + f for o, f in zip(order, first)]) if order else np.zeros(0, np.int64)
                out = []
                for doc, text, at, runs in zip(docs_of, own.to_pylist(), order, runs_of_rows(words.hashes[place], words.first)):
                    raw = (text or "").encode().split()
                    kept = at[kept_words(len(at), runs)] if runs else at
                    if len(kept) != len(raw) or doc is not None and crc32(str(doc).encode()) % 10 == 0:
                        raw = [raw[k] for k in kept.tolist()]
                    best = best_run(runs) or (None, None, None)
                    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    out.append((
                        doc, len(runs), *best, best[1] and 1000 * best[1] // best[2],
                        sha256(lines.encode()).hexdigest(), sha256(b" ".join(raw)).hexdigest(),
                    ))
                names = [c.split()[0] for c in RUN_DIGESTS.split(", ")]
                kinds = [pa.int64()] * 6 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, RUN_DIGESTS)
