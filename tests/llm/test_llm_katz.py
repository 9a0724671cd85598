"""The backoff model against a plain implementation over dictionaries."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import no_docs, odd_docs, odd_rows

from framescore.llm import katz
from framescore.llm.scratch import Scratch

LOWER = {i: i + 32 for i in range(65, 91)}


def _held(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2


def plain_discount(counts):
    """r to discounted r, by the rule of the docstring."""
    n = Counter(counts)
    for most in range(5, 0, -1):
        if all(n[r] for r in range(1, most + 2)):
            share = (most + 1) * n[most + 1] / n[1]
            if share < 1:
                d = {r: ((r + 1) * n[r + 1] / n[r] / r - share) / (1 - share) for r in range(1, most + 1)}
                if all(0 < x < 1 for x in d.values()):
                    return lambda r: d.get(r, 1.0) * r
    return lambda r: r - 0.5


class Plain:
    def __init__(self, docs, order):
        self.order, self.grams = order, [None] + [Counter() for _ in range(order)]
        begins = 0
        for doc, text in docs:
            if not _held(doc):
                tokens = ["<s>", *self.words(text), "</s>"]
                begins += 1
                for i in range(1, len(tokens)):
                    for n in range(1, min(order, i + 1) + 1):
                        self.grams[n][tuple(tokens[i - n + 1 : i + 1])] += 1
        self.discount = [None] + [plain_discount(self.grams[n].values()) for n in range(1, order + 1)]
        self.total = sum(self.grams[1].values())
        self.after = defaultdict(list)
        for n in range(2, order + 1):
            for g in self.grams[n]:
                self.after[g[:-1]].append(g[-1])
        self.times = {**{g: c for n in range(1, order) for g, c in self.grams[n].items()}, ("<s>",): begins}
        self.alphas = {}

    @staticmethod
    def words(text):
        return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))

    def p(self, gram):
        n = len(gram)
        if n == 1:
            if not self.total:
                return 1.0
            c = self.grams[1][gram]
            kept = sum(self.discount[1](x) for x in self.grams[1].values())
            return self.discount[1](c) / self.total if c else (self.total - kept) / self.total
        c = self.grams[n][gram]
        return self.seen(gram) if c else self.alpha(gram[:-1]) * self.p(gram[1:])

    def seen(self, gram):
        return self.discount[len(gram)](self.grams[len(gram)][gram]) / (self.times[gram[:-1]] + 0.05)

    def alpha(self, history):
        if history not in self.after:
            return 1.0
        if history not in self.alphas:
            upper = sum(self.seen((*history, w)) for w in self.after[history])
            lower = sum(self.p((*history[1:], w)) for w in self.after[history])
            self.alphas[history] = (1 - upper) / (1 - lower)
        return self.alphas[history]

    def score(self, text):
        tokens = ["<s>", *self.words(text), "</s>"]
        return sum(math.log10(self.p(tuple(tokens[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(tokens)))


def _docs(n=400, seed=1):
    r = random.Random(seed)
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(r.choices([f"W{j}" if j % 5 else f"w{j}é" for j in range(300)], weights, k=r.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_the_plain_model(spark, order):
    docs = _docs() + [(None, "w1 w2"), (1, "W1 unheard"), (2000, None), (2001, "")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    model = katz.Katz(table, katz.held_out(), Scratch(spark, "t"), order=order, block=2000)
    plain = Plain(docs, order)
    got = sorted(((r.doc_id, r.n_tokens, r.score, r.held_out, r.base_score, r.n_known, r.train_tokens) for r in model.scores().collect()), key=str)
    c, v = plain.grams[1], len(plain.grams[1])
    want = []
    for doc, text in docs:
        tokens = [*plain.words(text), "</s>"]
        base = sum(math.log10((c[w,] + 1) / (plain.total + v + 1)) for w in tokens)
        want.append((doc, len(tokens), plain.score(text), _held(doc), base, sum(c[w,] > 0 for w in tokens), plain.total))
    want.sort(key=str)
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[1], r[2])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:2] == b[:2] and a[3] == b[3] and a[5:] == b[5:]
        assert a[2] == pytest.approx(b[2], rel=1e-9) and a[4] == pytest.approx(b[4], rel=1e-9)
    counts = {r.gram: r.value for r in model.table(1).collect()}
    # The begin of a text is a history, and counted as one.
    assert sorted(counts.values()) == sorted([*c.values(), sum(not _held(d) for d, _ in docs)])
    if order > 1:
        assert sorted(r.value for r in model.table(2).collect()) == sorted(plain.grams[2].values())
        own = sorted(plain.alpha(h) for h in plain.after if len(h) == 1)
        assert sorted(r.value for r in model.table(2, "alphas").collect()) == pytest.approx(own, rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_after_a_history_sum_to_one(order):
    plain = Plain(_docs(300, 2), order)
    known = [g[0] for g in plain.grams[1]]
    for history in [("w0é", "W1"), ("<s>", "W2"), ("nobody", "said"), ("W1", "nobody")]:
        own = history[2 - (order - 1) :] if order > 1 else ()
        assert sum(plain.p((*own, w)) for w in [*known, "<unknown>"]) == pytest.approx(1)


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    r = random.Random(4)
    after = {i: [r.randrange(200) for _ in range(4)] for i in range(200)}

    def text():
        at, out = r.randrange(200), []
        for _ in range(80):
            out.append(f"w{at}")
            at = r.choice(after[at])
        return " ".join(out)

    table = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id bigint, text string")
    rows = katz.Katz(table, katz.held_out(), Scratch(spark, "t")).scores().where("held_out").collect()
    assert len(rows) > 30 and all(r.score > 0.6 * r.base_score for r in rows)


def test_defined_cases(spark):
    assert katz.Katz(no_docs(spark), katz.held_out(), Scratch(spark, "t")).scores().count() == 0
    rows = katz.Katz(odd_docs(spark), katz.held_out(), Scratch(spark, "t")).scores().collect()
    assert len(rows) == len(odd_rows()) and all(np.isfinite(r.score) and r.n_tokens >= 1 for r in rows)
    one = spark.createDataFrame([(next(i for i in range(99) if _held(i)), "nothing to learn from")], "doc_id bigint, text string")
    rows = katz.Katz(one, katz.held_out(), Scratch(spark, "t")).scores().collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.score) for r in rows] == [(True, 0, 0, 0.0)]


def test_discounts_fall_back():
    assert katz.Discounts([100, 40, 20, 12, 9, 7], 1000, 200).table is not None
    few = katz.Discounts([3, 0, 0, 0, 0, 0], 3, 3)
    assert few.table is None and few(np.array([0, 1, 4])).tolist() == [0, 0.5, 3.5] and few.freed == 1.5
