"""Periodic runs of words against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from cases import no_docs, odd_docs, odd_rows, prose

from framescore.llm import runs
from framescore.llm.words import mix


def brute(words) -> list[tuple[int, int, int]]:
    out, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            a, b = i, j + q
            smallest = not any(all(words[k] == words[k + p] for k in range(a, b - p)) for p in range(1, q))
            if b - a >= max(24, 3 * q) and smallest:
                out.append((a, b - a, q))
            i = j + 1
    return sorted(out)


def _words(kind: str, seed: int) -> list[int]:
    r = random.Random(seed)
    n = r.choice([0, 1, 23, 24, 25, 60, 120, 300])
    if kind == "random":
        k = r.choice([1, 2, 3])
        return [r.randrange(k) for _ in range(n)]
    if kind == "stretches":
        out = []
        while len(out) < n:
            base = [r.randrange(r.choice([1, 2, 40])) for _ in range(r.randint(1, 30))]
            out += [base[i % len(base)] for i in range(r.randint(1, 5 * len(base)))]
        return out[:n]
    if kind == "made periodic":
        own = [r.randrange(50) for _ in range(n)]
        return [own[i] for i in runs._periodic(n, 10 * r.randrange(10**6))]
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("kind", ["random", "stretches", "made periodic", "fibonacci"])
def test_runs_equal_brute_force_however_the_text_is_cut(kind):
    for seed in range(150):
        words = _words(kind, seed)
        hashed = mix(np.array(words, np.uint64) + np.uint64(7))
        whole, pieces = runs.Catcher(), runs.Catcher()
        whole.append(hashed)
        r, i = random.Random(seed), 0
        while i < len(words):
            step = r.choice([1, 1, 2, 7, 40])
            pieces.append(hashed[i : i + step])
            i += step
        assert whole.runs() == pieces.runs() == brute(words)


def test_runs_so_far_are_those_of_the_text_so_far():
    words = _words("stretches", 7)
    hashed = mix(np.array(words, np.uint64) + np.uint64(7))
    catcher = runs.Catcher()
    for i in range(len(words)):
        catcher.append(hashed[i : i + 1])
        if i % 17 == 0:
            assert catcher.runs() == brute(words[: i + 1])


def test_texts_in_one_stream_do_not_touch():
    texts = [_words("stretches", s) for s in range(40)] + [[5] * 40, [5] * 40, []]
    hashed = mix(np.array([w for t in texts for w in t], np.uint64) + np.uint64(7))
    first = np.cumsum([0, *map(len, texts)])
    assert runs.runs_of_rows(hashed, first) == [brute(t) for t in texts]


def test_long_periodic_texts_need_few_steps():
    for period in (1, 1000):
        catcher = runs.Catcher()
        catcher.append(mix(np.arange(400_000, dtype=np.uint64) % np.uint64(period)))
        assert catcher.runs() == [(0, 400_000, period)]


def test_runs_below_what_is_caught_are_refused():
    with pytest.raises(ValueError):
        runs.Catcher(least=10)


def _expected(doc, text):
    words = (text or "").encode().split()
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    digest = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return doc, len(found), *best, best[1] and 1000 * best[1] // best[2], digest(lines.encode()), digest(b" ".join(kept))


def test_digests_equal_brute_force(spark):
    docs = [(i, prose(40 + 3 * i % 200, i)) for i in range(200)] + [(1000 + i, "a b c " * (5 + i)) for i in range(30)]
    odd = [(r[0], r[1]) for r in odd_rows() if r[1] is None or len(r[1]) < 10_000]
    table = spark.createDataFrame(docs + odd, "doc_id bigint, text string").repartition(3)
    order = lambda rows: sorted(rows, key=str)
    got = order(tuple(r) for r in runs.digests(table).collect())
    assert got == order(_expected(*d) for d in docs + odd)
    assert sum(r[1] > 0 for r in got) > 20


def test_odd_rows_and_collapse(spark):
    assert runs.digests(no_docs(spark)).count() == 0 and runs.find_runs(no_docs(spark)).count() == 0
    assert len(runs.digests(odd_docs(spark)).collect()) == len(odd_rows())
    found = {(r.doc_id, r.start, r.length, r.period) for r in runs.find_runs(odd_docs(spark)).collect()}
    assert found == {(14, 0, 120, 3)}
    cut = runs.collapse(odd_docs(spark))
    assert cut.columns == odd_docs(spark).columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[14] == "line one two" and texts[6] == " \t\n" and texts[4] is None
