"""Rows that every operator must take: nulls, blanks, ties, repeats, long texts, columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # Names that operators use inside.
    "key string, size bigint, shard int, band string, target double, words int, component int"
)


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    made = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(r.randint(2, 9))) for _ in range(n)]
    return "".join(w + r.choice([" ", " ", " ", ", ", ". ", "\n"]) for w in made)


def odd_rows() -> list[tuple]:
    base = prose(120, 1)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, prose(120, 3), None, "a"), (4, None, "en", "a"), (5, "", "en", None),
        (6, " \t\n", "de", "a"), (7, prose(30_000, 7), "de", "b"), (8, "one", None, None), (9, "tie", "en", "c"), (10, "tie", "en", "c"),
        (11, "ab ab ab ab ab", "fr", "c"), (12, "x\x00y \x1c z\x85q \U0001f600", "fr", "c"), (None, prose(80, 12), "fr", "c"), (None, None, None, None),
        (13, base, "en", "a"), (13, base, "en", "a"), (-5, "w" * 5000, "en", "zz"), (14, "line one two\n" * 40, "en", "b"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "k", 3, 1, "b", 0.5, 9, 4) for i, t, lang, s in rows]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
