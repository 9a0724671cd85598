"""Compaction of rollups, odd rows, broken commits; overlapping control strings."""

from __future__ import annotations

import itertools
import random

import pytest
from cases import odd_docs

from framescore.llm import chat, tokencounts
from framescore.llm.tokencounts import Rollup

COUNTS = "doc_id bigint, source string, lang string, words bigint, key string, kind string"


def _events(spark, rows, kind="inserts"):
    table = spark.createDataFrame([(i, s, lang, n, "k", "other") for i, s, lang, n in rows], COUNTS)
    return getattr(tokencounts, kind)(table, "words", "words")


def _totals(rollup):
    return sorted((tuple(r) for r in rollup.totals().collect()), key=str)


def test_compaction_keeps_totals_and_ids(spark, tmp_path):
    rollup = Rollup(spark, f"{tmp_path}/r")
    assert rollup.compact() == 0
    r = random.Random(2)
    batches = {f"b{i}": [(j, r.choice("xyz"), r.choice(["en", None]), r.randrange(50)) for j in range(20)] for i in range(6)}
    for name, rows in itertools.islice(batches.items(), 4):
        rollup.commit(name, _events(spark, rows))
    before = _totals(rollup)
    assert rollup.compact() == 4 and rollup.compact() == 0
    assert _totals(rollup) == before and rollup.batches() == ["b0", "b1", "b2", "b3"]
    # A folded batch that is sent again changes nothing.
    assert not rollup.commit("b1", _events(spark, batches["b1"])) and _totals(rollup) == before
    for name in ("b4", "b5"):
        assert rollup.commit(name, _events(spark, batches[name]))
    after = _totals(rollup)
    assert rollup.compact() == 2
    # The folders of the first compaction's batches are gone now, those of the second one's stay until the next.
    assert sorted(p.name for p in (tmp_path / "r" / "deltas").iterdir()) == ["batch=b4", "batch=b5"]
    other = Rollup(spark, f"{tmp_path}/r")
    assert _totals(other) == after and other.batches() == sorted(batches) and all(other.committed(b) for b in batches)
    plain = {}
    for rows in batches.values():
        for _, s, lang, n in rows:
            d, t = plain.get((s, lang), (0, 0))
            plain[s, lang] = d + 1, t + n
    assert after == sorted(((s, lang, "words", d, t) for (s, lang), (d, t) in plain.items()), key=str)


def test_a_compaction_that_is_broken_off_does_not_count(spark, tmp_path, monkeypatch):
    rollup = Rollup(spark, f"{tmp_path}/r")
    rollup.commit("a", _events(spark, [(1, "x", "en", 5)]))
    before = _totals(rollup)

    class Store:
        def __getattr__(self, name):
            return getattr(rollup_fs, name)

        def rename(self, *_):
            return False

    rollup_fs = rollup._fs
    monkeypatch.setattr(rollup, "_fs", Store())
    with pytest.raises(FileExistsError):
        rollup.compact()
    monkeypatch.undo()
    assert _totals(rollup) == before and rollup.batches() == ["a"]
    assert rollup.compact() == 1 and _totals(rollup) == before


def test_odd_rows_empty_batches_and_commits_that_died(spark, tmp_path):
    rollup = Rollup(spark, f"{tmp_path}/r")
    counts = tokencounts.count_tokens(odd_docs(spark))
    assert rollup.commit("odd", tokencounts.inserts(counts, "words", "words"))
    n = sum(r.documents for r in rollup.totals().collect())
    assert n == odd_docs(spark).count()
    assert rollup.commit("none", _events(spark, [])) and rollup.committed("none")
    # What a dead commit left has no success marker.
    _events(spark, [(1, "x", "en", 5)]).write.parquet(f"{tmp_path}/r/deltas/batch=dead")
    (tmp_path / "r" / "deltas" / "batch=dead" / "_SUCCESS").unlink()
    assert not rollup.committed("dead") and sum(r.documents for r in rollup.totals().collect()) == n
    assert rollup.compact() == 2
    assert rollup.commit("dead", _events(spark, [(1, None, None, 5)])) and sum(r.documents for r in rollup.totals().collect()) == n + 1
    rollup.commit("back", tokencounts.deletes(counts, "words", "words"))
    assert _totals(rollup) == [(None, None, "words", 1, 5)]


def test_no_control_string_is_left_at_any_offset():
    pieces = ["<", "|", ">", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "a", "<|", "|>"]
    r = random.Random(9)
    texts = ["".join(p) for n in (1, 2, 3) for p in itertools.product(pieces, repeat=n)]
    texts += ["".join(r.choices(pieces, k=12)) for _ in range(2000)]
    for text in texts:
        made = chat.escape(text)
        assert not any(mark in made for mark in chat.CONTROL) and chat.unescape(made) == text
        assert chat.read_back(chat.default_template([("user", text), (text, "x")])) == [("user", text), (text, "x")]
