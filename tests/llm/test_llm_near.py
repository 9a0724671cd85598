"""Near-duplicates, passages and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from cases import prose
from pyspark.sql import functions as F

from framescore.llm import editembed, linking, minhash, passages
from framescore.llm.scratch import Scratch
from framescore.llm.words import SPACES, hash_words


def _groups(pairs, items):
    name = {i: i for i in items}

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        name[b] = a
    return {i: top(i) for i in items}


def _edited(text: str, n: int, seed: int) -> str:
    r, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.random()}"
    return " ".join(w)


def _near_docs() -> list[tuple[int, str]]:
    out, chain = [], prose(200, 1)
    for i in range(12):
        # A chain: neighbours are near, ends are not.
        chain = _edited(chain, 3, i)
        out.append(chain)
    out += [_edited(prose(150, 50), i % 12, 100 + i) for i in range(40)]
    shared = prose(60, 60)
    out += [shared + prose(50, 200 + i) for i in range(40)]
    out += [prose(100, 400 + i) for i in range(30)] + ["again and again " * 30] * 3 + ["again and again " * 30 + "and more", "a b c", "a b c", "", ""]
    return list(enumerate(out))


def _jaccard(x: Counter, y: Counter) -> float:
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def _shingles(text: str) -> Counter:
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_near_duplicate_classes_are_those_of_all_pairs(spark):
    docs = _near_docs()
    bags = {i: _shingles(t) for i, t in docs}
    pairs = [(i, j) for i, s in docs for j, t in docs if i < j and (s == t or bags[i] and bags[j] and _jaccard(bags[i], bags[j]) >= 0.8)]
    want = _groups(pairs, bags)
    got = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(docs, "doc_id bigint, text string"), Scratch(spark, "t")).collect()}
    assert got == want


def test_members_of_a_hot_group_are_linked_by_any_one_pair(spark, monkeypatch):
    # Copies of one text, near each other, and stragglers that are alike in twos only; all buckets hold all of them.
    made = minhash.sketches
    monkeypatch.setattr(minhash, "sketches", lambda docs: made(docs).selectExpr("doc_id", "key", "array(1L, 2L, 3L) AS bands"))
    base = prose(200, 31)
    docs = [_edited(base, 2, 9000 + i) for i in range(60)]
    for i in range(25):
        far = _edited(base, 14, 20_000 + i)
        docs += [far, _edited(far, 2, 30_000 + i)]
    bags = {i: _shingles(t) for i, t in enumerate(docs)}
    # No shingle repeats, so the measure is the plain Jaccard similarity.
    assert all(max(b.values()) == 1 for b in bags.values())
    alike = lambda x, y: (n := len(x.keys() & y.keys())) / (len(x) + len(y) - n)
    want = _groups([(i, j) for i in bags for j in range(i + 1, len(bags)) if alike(bags[i], bags[j]) >= 0.8], bags)
    assert len(set(want.values())) > 20
    got = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), Scratch(spark, "t")).collect()}
    assert got == want


def test_drawn_members_are_the_centres(spark):
    rows = [("x", f"k{i:02}", "main" if i % 2 else f"k{i:02}") for i in range(40)]
    large = spark.createDataFrame(rows, "band string, key string, component string")
    pairs = linking._stragglers(large, 1).collect()
    # One drawn inside the largest component, and one of the rest.
    assert len({p.a for p in pairs}) == 2 and len({p.b for p in pairs}) == 20


def test_prefixes_hold_every_pair_that_can_be_near(spark):
    r, rows = random.Random(5), []
    for i in range(60):
        bag = Counter({e: r.choice([1, 1, 1, 3]) for e in r.sample(range(12), r.randint(5, 11))})
        rows.append((i, bag))
    elements = spark.createDataFrame([(i, e, n, b.total()) for i, b in rows for e, n in b.items()], "key bigint, element bigint, weight bigint, total bigint")
    parts = spark.createDataFrame([(i, i // 2) for i, _ in rows], "key bigint, component bigint")
    got = {(p.a, p.b) for p in linking.prefix_pairs(parts, elements, 0.8, Scratch(spark, "t")).collect()}
    want = {(i, j) for i, x in rows for j, y in rows if i < j and i // 2 != j // 2 and _jaccard(x, y) >= 0.8}
    assert want and want <= got and all(i // 2 != j // 2 for i, j in got)


def test_hubs_join_all_that_pairs_join_with_fewer_comparisons(spark):
    # Copies of one set edited in places of their own, copies of such copies, sets that share a few elements only, and bags.
    r, fresh = random.Random(0), iter(range(1000, 10**6))

    def edited(x, drop, add):
        return set(r.sample(sorted(x), len(x) - drop)) | {next(fresh) for _ in range(add)}

    base = set(range(100))
    sets = [edited(base, r.randint(0, 8), r.randint(0, 8)) for _ in range(100)]
    for _ in range(40):
        far = edited(base, r.randint(9, 14), r.randint(9, 14))
        sets += [far, edited(far, r.randint(0, 14), r.randint(0, 14))]
    sets += [set(range(10)) | {next(fresh) for _ in range(r.randint(1, 60))} for _ in range(30)] + [edited(base, r.randint(0, 30), 0) for _ in range(30)]
    bags = [Counter({e: 1 + (i % 9 == 0 and r.random() < 0.2) for e in x}) for i, x in enumerate(sets)]
    rows = [(i, e, n, b.total()) for i, b in enumerate(bags) for e, n in b.items()]
    elements = spark.createDataFrame(rows, "key bigint, element bigint, weight bigint, total bigint")
    lists = [(np.array(sorted(b), np.uint64), np.array([b[e] for e in sorted(b)])) for b in bags]
    alike = {(i, j): minhash.probability_jaccard(*lists[i], *lists[j]) for j in range(len(bags)) for i in range(j)}
    near = [p for p, s in alike.items() if s >= 0.8]
    for begun in ({i: i for i in range(len(bags))}, _groups([p for p in near if p[1] < 90], range(len(bags)))):
        parts = spark.createDataFrame(list(begun.items()), "key bigint, component bigint")
        start = [(i, c) for i, c in begun.items()]
        every, few = ([(p.a, p.b) for p in linking.prefix_pairs(parts, elements, 0.8, Scratch(spark, "t"), hot).collect()] for hot in (10**9, 8))
        assert len(few) < 0.8 * len(every)
        for got in (every, few):
            assert all(i < j and begun[i] != begun[j] for i, j in got) and len(set(got)) == len(got)
            assert _groups([p for p in got if alike[p] >= 0.8] + start, range(len(bags))) == _groups(near + start, range(len(bags)))


def test_registers_agree_as_often_as_the_similarity_says():
    texts = [prose(100, 1), _edited(prose(100, 1), 4, 2), "go on " * 20 + prose(40, 3), "go on " * 50 + prose(40, 3)]
    row, element, weight = minhash.weighted_shingles(pa.array(texts))
    held = minhash.prob_minhash(row, element, weight, 4, 4096)
    for i, j in ((0, 1), (2, 3), (0, 2)):
        assert abs((held[i] == held[j]).mean() - _jaccard(_shingles(texts[i]), _shingles(texts[j]))) < 0.04


def test_exact_similarity():
    a, b = np.array([1, 2, 3], np.uint64), np.array([2, 3, 4], np.uint64)
    assert minhash.probability_jaccard(a, None, b, None) == 0.5
    x, y = Counter({1: 3, 2: 1, 3: 2}), Counter({2: 5, 3: 1, 4: 1})
    assert abs(minhash.probability_jaccard(a, np.array([3, 1, 2]), b, np.array([5, 1, 1])) - _jaccard(x, y)) < 1e-12


@pytest.mark.parametrize("edits", [0, 3])
def test_planted_passages_are_found_and_nothing_else(spark, edits):
    docs = {i: prose(150, 1000 + i).split() for i in range(80)}
    planted = {}
    for g in range(6):
        passage = prose(70, 5000 + g).split()
        for d in range(g * 4, g * 4 + 4):
            own = _edited(" ".join(passage), edits if d % 4 else 0, d).split(" ")
            at = 20 + 7 * (d % 5)
            docs[d][at:at] = own
            planted[d] = (g, at, at + len(own))
    rows = [(i, " ".join(w)) for i, w in docs.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    s = Scratch(spark, "t")
    found = s.write(passages.passages(df, s), "found")
    pairs = _groups([(r.doc_id, r.earlier_id) for r in found.collect()], docs)
    assert pairs == {i: planted[i][0] * 4 if i in planted else i for i in docs}
    for r in found.collect():
        # An edit among the last words of either copy may cost the words beyond it.
        slack = 2 + 2 * edits
        assert abs(r.start_word - planted[r.doc_id][1]) <= slack and abs(r.end_word - planted[r.doc_id][2]) <= slack
    cut = {r.doc_id: r.text.split() for r in passages.cut_passages(df, found).collect()}
    for i, w in docs.items():
        if i not in planted or i % 4 == 0:
            assert cut[i] == w
        else:
            assert abs(len(cut[i]) - (len(w) - 70)) <= 3 + 3 * edits


def test_each_copy_of_a_passage_in_one_document_is_found(spark):
    p, x, y, z = (prose(n, 70 + n).split() for n in (80, 150, 151, 152))
    docs = [(1, x[:60] + p + x[60:]), (2, y[:40] + p + y[40:90] + p + y[90:] + p), (3, z)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")
    s = Scratch(spark, "t")
    found = s.write(passages.passages(df, s), "found")
    assert {(r.doc_id, r.earlier_id) for r in found.collect()} == {(2, 1)}
    cut = {r.doc_id: r.text.split() for r in passages.cut_passages(df, found).collect()}
    assert cut == {1: docs[0][1], 2: y, 3: z}


def _hidden(lines: list[list[str]]) -> list[list[str]]:
    """Two documents that share all lines in order, and between them one that holds each line alone."""
    texts = [[prose(40, 800)] + lines + [prose(40, 801)]] + [[prose(60, 810 + i), line, prose(60, 900 + i)] for i, line in enumerate(lines)]
    return [" ".join(t).split() for t in [*texts, [prose(30, 802)] + lines + [prose(30, 803)]]]


@pytest.mark.parametrize("n, size", [(3, 25), (4, 30), (3, 45), (8, 12), (40, 20)])
def test_passages_of_common_lines_are_found_past_nearer_holders_of_one(spark, n, size):
    for seed in range(3):
        lines = [prose(size, 3000 + 100 * seed + i) for i in range(n)]
        docs = list(enumerate(_hidden(lines)))
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")
        found = passages.passages(df, Scratch(spark, "t")).collect()
        # Brute force: no two other documents share 50 words in a row.
        runs = [{tuple(w[i : i + 50]) for i in range(len(w) - 49)} for _, w in docs]
        assert [(i, j) for i in range(len(runs)) for j in range(i) if runs[i] & runs[j]] == [(n + 1, 0)]
        assert {(r.doc_id, r.earlier_id) for r in found} == {(n + 1, 0)}
        assert min(r.start_word for r in found) <= 30 and max(r.end_word for r in found) >= 30 + n * size


def _behind_chunks() -> list[tuple[int, str]]:
    """Documents 0 and 9 share 60 words (some differ in 11); those between hold 45 of them each, no two the same, and so each of their seeds' keys."""
    rows = []
    for g in range(4):
        p, base = prose(60, 6100 + g).split(), 100 * g
        chunks = [(i + 1, p[lo : lo + 45]) for i, lo in enumerate((0, 3, 6, 9, 12, 15))]
        for i, own in [(0, p), *chunks, (9, p), (11, _edited(" ".join(p), 2, g).split(" "))]:
            rows.append((base + i, " ".join([prose(70, 6200 + base + i), *own, prose(70, 7200 + base + i)])))
    return rows


@pytest.mark.parametrize("hot", [256, 2])
def test_passages_are_found_behind_nearer_holders_of_all_their_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(passages, "HOT", hot)
    rows = [r for r in _behind_chunks() if r[0] % 100 != 11]
    found = passages.passages(spark.createDataFrame(rows, "doc_id bigint, text string"), Scratch(spark, "t")).collect()
    runs = {i: {tuple(w[n : n + 50]) for n in range(len(w) - 49)} for i, t in rows for w in [t.split()]}
    exact = {(i, j) for i in runs for j in runs if j < i and runs[i] & runs[j]}
    assert exact == {(100 * g + 9, 100 * g) for g in range(4)}
    spans = {r.doc_id: (r.start_word, r.end_word) for r in found if (r.doc_id, r.earlier_id) in exact}
    assert set(spans) == {i for i, _ in exact} and all(lo <= 70 and hi >= 130 for lo, hi in spans.values())


def test_further_matches_are_all_those_that_agree(spark, monkeypatch):
    df = spark.createDataFrame(_behind_chunks(), "doc_id bigint, text string")
    s = Scratch(spark, "t")
    hits = s.write(passages.matches(passages.seeds(df)), "hits")
    none = spark.createDataFrame([], passages.PASSAGE)
    words = {r.doc_id: hash_words(pa.array([r.text])).hashes >> np.uint64(32) | np.uint64(1) for r in df.collect()}
    reach = np.arange(passages.K - passages.NEAR - passages.BAND, passages.NEAR + passages.BAND)
    about = lambda d, at: [int(words[d][at + n]) if 0 <= at + n < len(words[d]) else 0 for n in reach]

    def score(a, b):
        hit = [a[n] != 0 and a[n] in b[n - passages.BAND : n + passages.BAND + 1] for n in range(passages.BAND, len(a) - passages.BAND)]
        return max(sum(hit[n : n + passages.NEAR]) for n in range(len(hit) - passages.NEAR + 1))

    places = [(r.seed, r.doc_id, r.at) for r in passages.seeds(df, runs=(1,)).collect()]
    wanted = {(d, e, i, j) for s1, d, i in places for s2, e, j in places if s1 == s2 and e < d and score(about(d, i), about(e, j)) >= passages.AGREE}
    for hot in (256, 0):
        monkeypatch.setattr(passages, "HOT", hot)
        got = passages.further_matches(df, hits, none, s).collect()
        assert len(got) == len(wanted) > 0 and {(r.doc_id, r.earlier_id, r.at, r.earlier_at) for r in got} == wanted


@pytest.mark.parametrize("crowd", [0, 2])
def test_crowded_seeds_are_matched_as_pair_by_pair(spark, monkeypatch, crowd):
    df = spark.createDataFrame(_behind_chunks(), "doc_id bigint, text string")
    s, none = Scratch(spark, "t"), spark.createDataFrame([], passages.PASSAGE)
    hits = s.write(passages.matches(passages.seeds(df)), "hits")
    whole, ends = (passages.further_matches(df, hits, none, s, stretched=e).collect() for e in (False, True))
    # Chunks of 45 words agree, but no stretch of 50 that begins and ends with equal words is in two of them.
    assert set(ends) < set(whole) and {(r.doc_id % 100, r.earlier_id % 100) for r in ends} >= {(9, 0), (11, 0), (11, 9)} and len(ends) < 0.5 * len(whole)
    monkeypatch.setattr(passages, "HOT", 0)
    monkeypatch.setattr(passages, "OPEN", 0)
    monkeypatch.setattr(passages, "CROWD", crowd)
    for e, wanted in ((False, whole), (True, ends)):
        got = passages.further_matches(df, hits, none, s, stretched=e).drop("rank").collect()
        assert sorted(map(tuple, got)) == sorted(tuple(r)[:-1] for r in wanted)


def test_rows_that_agree_share_a_key():
    r, found = np.random.default_rng(3), 0
    for _ in range(300):
        # Few words, some of them all over; the other row is a copy with up to 20 words changed.
        a = (r.zipf(1.3, passages.ABOUT) % 60 + 1).astype(np.int32)
        b = np.where(r.random(passages.ABOUT) < r.random() * 0.4, r.integers(1, 60, passages.ABOUT), a)
        count = r.integers(2, 40, 61)
        if np.convolve(np.isin(a, b), np.ones(passages.NEAR), "valid").max() >= passages.AGREE:
            found += 1
            for crowd in (0, 10, 40):
                single, double = passages.rare_keys(np.arange(passages.ABOUT), count[a], a, crowd)
                assert single & set(b.tolist()) or any({x, y} <= set(b.tolist()) for x, y in double)
    assert found > 50


def test_documents_of_a_crowd_meet_by_a_second_word(spark, monkeypatch):
    monkeypatch.setattr(passages, "HOT", 16)
    r, line, made = random.Random(5), prose(14, 4400), []
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join([*r.choices(vocabulary, k=70), line, *r.choices(vocabulary, k=70)])) for i in range(300)]
    df, s = spark.createDataFrame(rows, "doc_id bigint, text string"), Scratch(spark, "t")
    hits = s.write(passages.matches(passages.seeds(df)), "hits")
    for crowd in (10**6, 2):
        monkeypatch.setattr(passages, "CROWD", crowd)
        before = set(s.paths)
        assert passages.further_matches(df, hits, spark.createDataFrame([], passages.PASSAGE), s).count() == 0
        made.append(spark.read.parquet(*[p for n, p in s.paths.items() if n not in before and "/pairs-" in p]).count())
    assert made[1] < 0.5 * made[0]


def test_documents_of_a_crowd_meet_by_words_in_like_places_only(spark, monkeypatch):
    monkeypatch.setattr(passages, "HOT", 16)
    monkeypatch.setattr(passages, "CROWD", 2)
    r, line, n = random.Random(6), prose(14, 4500), 200
    vocabulary = [f"w{i}" for i in range(600)]
    rows = [(i, " ".join([*r.choices(vocabulary, k=60), line, *r.choices(vocabulary, k=60)])) for i in range(n)]
    rows += [(n + i, " ".join([prose(50, 6700 + i), rows[i][1], prose(50, 7700 + i)])) for i in range(4)]
    df, s = spark.createDataFrame(rows, "doc_id bigint, text string"), Scratch(spark, "t")
    hits = s.write(passages.matches(passages.seeds(df)), "hits")
    got = passages.further_matches(df, hits, spark.createDataFrame([], passages.PASSAGE), s).collect()
    assert {(r.doc_id, r.earlier_id) for r in got} == {(n + i, i) for i in range(4)}
    pairs = spark.read.parquet(*[p for p in s.paths.values() if "/pairs-" in p])
    assert pairs.select("doc_id", "earlier_id").distinct().count() < 0.6 * n * (n - 1) / 2


@pytest.mark.parametrize("bits", [1, 1 << 24])
def test_rows_meet_those_that_hold_both_tokens_of_a_key(monkeypatch, bits):
    monkeypatch.setattr(passages, "BITS", bits)
    r, wide = np.random.default_rng(4), passages.ABOUT + 2 * passages.BAND
    words = r.integers(0, 300, (40, wide)).astype(np.int32)
    size = r.integers(0, 5, 30)
    word, place = r.integers(1, 300, (size.sum(), 2)).astype(np.int32), r.integers(0, passages.ABOUT, (size.sum(), 2))
    stretch = place // (passages.BAND + 1)
    one = r.random(len(word)) < 0.2
    first, second = passages.tokens(word[:, 0], stretch[:, 0]), np.where(one, 0, passages.tokens(word[:, 1], stretch[:, 1]))

    def holds(j, w, b):
        # A place of the stretch sees those at most BAND off; the row's words begin BAND places before the first.
        lo, hi = b * (passages.BAND + 1), min((b + 1) * (passages.BAND + 1), passages.ABOUT)
        return bool((words[j, lo : hi + 2 * passages.BAND] == w).any())

    wanted, at = set(), 0
    for i, n in enumerate(size):
        for k in range(at, at + n):
            wanted |= {(i, j) for j in range(len(words)) if holds(j, word[k, 0], stretch[k, 0]) and (one[k] or holds(j, word[k, 1], stretch[k, 1]))}
        at += n
    got = [(int(i), int(j)) for a, b in passages._meeting(size, first, second, words) for i, j in zip(a, b)]
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 20


@pytest.mark.parametrize("side", [3, 7])
def test_blocks_of_places_give_the_same_matches(spark, monkeypatch, side):
    df = spark.createDataFrame(_behind_chunks(), "doc_id bigint, text string")
    s, none = Scratch(spark, "t"), spark.createDataFrame([], passages.PASSAGE)
    hits = s.write(passages.matches(passages.seeds(df)), "hits")
    whole = sorted(map(tuple, passages.further_matches(df, hits, none, s).collect()))
    monkeypatch.setattr(passages, "HOT", 0)
    monkeypatch.setattr(passages, "SIDE", side)
    for least in (0, 4):
        monkeypatch.setattr(passages, "OPEN", least)
        assert sorted(map(tuple, passages.further_matches(df, hits, none, s).collect())) == whole


def test_chains_in_slices_give_the_same_passages_and_tables_on_the_way_go(spark, monkeypatch):
    # All hold a word 45 times, so their seeds agree; two share 60 words as well.
    rows = [(i, " ".join([prose(70, 8100 + i), "again " * 45, prose(70, 8200 + i), prose(60, 8300) if i in (3, 9) else ""])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")

    def run():
        s = Scratch(spark, "t")
        found = sorted(map(tuple, passages.passages(df, s).collect()))
        there = [Path(p).name.rsplit("-", 1)[0] for p in s.paths.values() if Path(p.removeprefix("file:")).exists()]
        return found, there

    whole, before = run()
    monkeypatch.setattr(passages, "CHAINS", 1)
    found, there = run()
    assert whole == found and {(r[0], r[3]) for r in found} == {(9, 3)}
    assert there.count("aligned") > before.count("aligned")
    assert "further" in there and not {"matches", "left", "places", "about", "counts", "asked", "pairs"} & set(there)


def test_chains_without_hope_give_no_passage(monkeypatch):
    judge, hopes, passed = passages.hopeless, Counter(), 0
    r = np.random.default_rng(8)
    for _ in range(1500):
        # Runs of few words, some kept, some changed, dropped or put in; matches are equal words in step.
        a = np.repeat(r.integers(0, 12, 40), r.integers(1, 30, 40))[:160].astype(np.int64)
        kind, p = r.random(len(a)), r.choice([0.05, 0.2, 0.4])
        b = np.concatenate([[w] if x > p else ([r.integers(100, 200)] if x > p / 3 else ([] if x > p / 6 else [w, w])) for w, x in zip(a, kind)] + [np.zeros(0)]).astype(np.int64)
        lo = int(r.integers(0, 60))
        b = np.concatenate([r.integers(200, 300, lo), b[lo : lo + int(r.integers(30, 120))], r.integers(300, 400, 60)])
        same = [i for i in range(min(len(a), len(b)) - 5) if (a[i : i + 6] == b[i : i + 6]).all()]
        if not same:
            continue
        at = np.array(same[: 1 + int(r.integers(0, 3))])
        more = tuple(map(bool, r.integers(0, 2, 2))), tuple(map(bool, r.integers(0, 2, 2)))
        with monkeypatch.context() as m:
            m.setattr(passages, "hopeless", lambda *x: False)
            found, beyond = passages._alike(a, b, at, at, 50, 0.8, *more)
        hopes[judge(a, b, at, at, 50, 0.8, *more)] += 1
        passed += bool(found)
        assert not judge(a, b, at, at, 50, 0.8, *more) or (not found and not beyond)
    assert hopes[True] > 100 and passed > 50, (hopes, passed)


def test_scratch_tables_leave_no_shuffle_files(spark):
    root = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {p for p in root.rglob("shuffle_*.data")}
    before = files()
    table = Scratch(spark, "t").write(spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    assert not files() - before
    assert table.count() == 7 and table.join(table.groupBy("k").count().withColumnRenamed("count", "n"), "k").count() == 7


def test_alignment_goes_on_beyond_the_words_fetched_first(spark):
    # One seed's holder shares 400 words on both sides of it.
    shared = prose(800, 77)
    rows = [(1, f"{prose(700, 78)} {shared} {prose(30, 79)}"), (2, f"{prose(40, 80)} {shared} {prose(700, 81)}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    linked = spark.createDataFrame([(0, 2, 1, [440], [1100])], "chain bigint, doc_id bigint, earlier_id bigint, at array<int>, earlier_at array<int>")
    short, whole = (passages._aligned(df, linked, m, 50, 0.8).collect() for m in (64, 4096))
    assert [r.beyond for r in short] == [True]
    assert [(r.start_word, r.end_word, r.earlier_start, r.earlier_end) for r in whole] == [(40, 840, 700, 1500)]


def test_chains_beat_all_ordered_subsets():
    r = random.Random(4)
    for _ in range(60):
        n = r.randint(1, 7)
        at, other = np.array([r.randint(0, 60) for _ in range(n)]), np.array([r.randint(0, 60) for _ in range(n)])

        def score(chain):
            return 6 * len(chain) - passages.GAP * sum((at[j] - at[i]) + (other[j] - other[i]) for i, j in zip(chain, chain[1:]))

        best = 0.0
        for mask in range(1, 1 << n):
            chain = sorted((i for i in range(n) if mask >> i & 1), key=lambda i: (at[i], other[i]))
            steps = list(zip(chain, chain[1:]))
            if all(at[i] < at[j] and other[i] < other[j] and at[j] - at[i] <= passages.MAX_GAP and other[j] - other[i] <= passages.MAX_GAP for i, j in steps):
                best = max(best, score(chain))
        got = passages.chains(at, other)
        assert sorted(i for c in got for i in c) == list(range(n))
        assert max(score(c) for c in got) >= best - 1e-9 or best - max(score(c) for c in got) < 6


def test_best_chain_over_thousands_of_positions():
    r = random.Random(8)
    for _ in range(40):
        own = [(p, p + r.randint(-40, 40)) for p in sorted(r.sample(range(6000), 150))] + [(r.randint(0, 6000), r.randint(0, 6000)) for _ in range(60)]
        own = [(p, q + 50) for p, q in own] + [(9, 9)] * 2
        at, other = map(np.array, zip(*own))
        order, score = sorted(range(len(own)), key=lambda i: own[i]), {}
        for i in order:
            reach = [score[j] - passages.GAP * (at[i] - at[j] + other[i] - other[j]) for j in score if 0 < at[i] - at[j] <= passages.MAX_GAP and 0 < other[i] - other[j] <= passages.MAX_GAP]
            score[i] = 6 + max(0, *reach, 0)
        best = passages.chains(at, other)[0]
        got = 6 * len(best) - passages.GAP * sum(at[j] - at[i] + other[j] - other[i] for i, j in zip(best, best[1:]))
        assert abs(got - max(score.values())) < 1e-6
        assert all(0 < at[j] - at[i] <= passages.MAX_GAP and 0 < other[j] - other[i] <= passages.MAX_GAP for i, j in zip(best, best[1:]))


def test_a_chain_behind_a_long_one_is_whole():
    # A stretch of 35 matches, and 400 words on another of four.
    at = np.array([*range(0, 315, 9), *range(715, 751, 9)])
    assert sorted(map(len, passages.chains(at, at))) == [4, 35]


def test_a_document_that_is_all_repeat_goes(spark):
    text = prose(90, 1)
    df = spark.createDataFrame([(1, text, 5), (2, text, 5), (3, prose(90, 2), 7)], "doc_id bigint, text string, n_chars bigint")
    found = passages.passages(df, Scratch(spark, "t"))
    assert sorted((r.doc_id, r.n_chars) for r in passages.cut_passages(df, found).collect()) == [(1, 5), (3, 7)]


def test_next_document_and_edited_text(spark):
    docs = {i * 3 - 40: prose(5 + i % 40, i)[: 200 if i % 5 else 0] for i in range(120)}
    order = sorted(docs, reverse=True)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    plain = editembed.with_next(df, per_bucket=9)
    assert plain.where("_copy").count() == plain.select("_bucket").distinct().count() > 5
    got = {r.doc_id: r for r in editembed.next_digests(df).collect()}
    own = dict(zip(order, editembed.fingerprints([docs[i] for i in order])))
    for i, after in zip(order, [*order[1:], order[0]]):
        text, half = docs[i], len(docs[i]) // 2
        edited = text[: len(text) - half] + docs[after][:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].fingerprint == own[i] and got[i].edited_fingerprint == editembed.fingerprints([edited])[0]
        assert got[i].near_next == editembed.likeness(own[i], own[after]) and 0 <= got[i].near_edited <= 1


def test_fingerprints_do_not_depend_on_their_block():
    texts = [prose(n, n) for n in (1, 2, 30, 400, 3000)] + ["", "a"]
    together = editembed.fingerprints(texts)
    assert together == [editembed.fingerprints([t])[0] for t in texts]


def test_likeness_follows_edits():
    texts = [prose(300, i) for i in range(30)]
    own = editembed.fingerprints(texts)
    means = []
    for n in (0, 1, 4, 40, 200):
        means.append(np.mean([editembed.likeness(a, b) for a, b in zip(own, editembed.fingerprints([_edited(t, n, 1) for t in texts]))]))
    assert means[0] == 1 and all(a > b for a, b in zip(means, means[1:])) and means[1] > 0.9
    assert np.mean([editembed.likeness(a, b) for a, b in zip(own, own[1:])]) < 0.1


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_similarity():
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 90))) for _ in range(2))
        assert abs(editembed.edit_similarity(a, b) - (1 - _levenshtein(a, b) / max(1, len(a), len(b)))) < 1e-12


def test_edit_classes_find_copies_with_few_edits(spark):
    base = {i: prose(120, 700 + i) for i in range(25)}
    docs = {**base, **{100 + i: _edited(t, 2, i) for i, t in base.items()}, **{200 + i: t for i, t in base.items()}}
    got = {r.doc_id: r.class_id for r in editembed.near_classes(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), Scratch(spark, "t")).collect()}
    assert all(got[200 + i] == got[i] for i in base)
    assert sum(got[100 + i] == i for i in base) >= 0.9 * len(base)
    assert len({got[i] for i in base}) == len(base)


def test_spaces_are_those_of_the_pattern():
    assert SPACES == "".join(map(chr, [32, 9, 10, 11, 12, 13]))


def test_each_window_has_a_seed_of_its_least_hash_and_repeats_have_few():
    rng, w = np.random.default_rng(5), 16
    for period in (1, 2, 3, 7, 20, 300):
        run = np.tile(rng.integers(0, 10**9, period), 400 // period + 1)[:400].astype(np.uint64)
        row = np.sort(rng.integers(0, 3, len(run)))
        chosen = passages.minimisers(run, row, w)
        for i in range(len(run) - w + 1):
            if row[i] == row[i + w - 1]:
                assert (run[chosen[(chosen >= i) & (chosen < i + w)]] == run[i : i + w].min()).any()
    assert len(passages.minimisers(np.ones(1600, np.uint64), np.zeros(1600, int), w)) == 100


def test_a_word_repeated_is_one_passage_with_a_chain_per_stretch(spark):
    df = spark.createDataFrame([(1, "word " * 900), (2, prose(40, 1) + "word " * 900 + prose(40, 2)), (3, prose(90, 3))], "doc_id bigint, text string")
    found = passages.passages(df, Scratch(spark, "t")).collect()
    assert {r.doc_id for r in found} == {2}
    covered = {w for r in found for w in range(r.start_word, r.end_word)}
    assert set(range(40, 940)) <= covered and min(covered) >= 36 and max(covered) < 944
    assert len(found) <= 900 / passages.CELL + 2


def test_chains_within_a_cover_that_failed_are_aligned(spark):
    rows = [(1, 0, 100, 0), (1, 10, 50, 1), (1, 60, 120, 2), (1, 0, 100, 3), (2, 10, 50, 4)]
    ends = spark.createDataFrame(rows, "doc_id bigint, lo int, hi int, chain bigint")
    assert {r.chain for r in passages._outside(ends).collect()} == {0, 2, 4}
    covers = spark.createDataFrame([(1, 0, 100), (2, 11, 90)], "doc_id bigint, lo int, hi int")
    assert {r.chain for r in passages._outside(ends, covers).collect()} == {2, 4}
    assert {r.chain for r in passages._outside(ends, covers.limit(0)).collect()} == {0, 1, 2, 3, 4}
