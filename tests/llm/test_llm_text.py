"""Words, tokens, packing, chats and token totals against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from cases import prose

from framescore.llm import chat, packing, tokencounts, words
from framescore.llm.scratch import Scratch
from framescore.llm.tokens import default_vocabulary, tokenizer

TEXTS = [
    prose(400, 5), "a b it's 12 ΑΣ Σ!! <|endoftext|> x　y\x1cz\x85q﻿r é é </w>", "end. a., .. x.. It's. É. H̱ K. I. İ.", "", None, " \n",
    "no break 1st 2nd ＡＢ", "x" * 3000, "\t\x0b\x0c\rq",
]


def test_words_are_those_of_the_pattern():
    found = words.hash_words(pa.array(TEXTS))
    plain = [re.findall(words.WORD, t or "") for t in TEXTS]
    assert np.diff(found.first).tolist() == [len(p) for p in plain]
    raw = found.data.tobytes()
    assert [raw[s:e].decode() for s, e in zip(found.start, found.end)] == [w for p in plain for w in p]
    by_word = dict(zip([w for p in plain for w in p], found.hashes.tolist()))
    assert len(set(by_word.values())) == len(by_word)


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    whole = words.hash_words(pa.array(TEXTS)).hashes
    monkeypatch.setattr(words, "BLOCK", 50)
    assert (words.hash_words(pa.array(TEXTS)).hashes == whole).all()


def test_tokens_are_those_of_whole_texts():
    t = tokenizer(default_vocabulary())
    ids, bounds = t.encode(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == t.model.encode(text or "", add_special_tokens=False).ids


def test_differencing_is_near_equal_and_bounded():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 300):
        sizes = r.integers(1, 513, n)
        window, k = packing.pack_block(sizes, 2048)
        sums = np.bincount(window, sizes, minlength=k)
        assert sums.max() <= 2048 and len(window) == n and k <= max(1, int(sizes.sum() / 2048 * 1.02) + 1)
    window, largest = packing.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert largest == 16 and np.bincount(window, [8, 7, 6, 5, 4]).tolist() in ([16, 14], [14, 16])


def test_packing_is_a_round_trip(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, prose(3000, 9), *[prose(n, n) for n in range(1, 300, 3)]])]
    packed = packing.pack(packing.cut_pieces(spark.createDataFrame(rows, "doc_id bigint, text string"), with_ids=True)).collect()
    t = tokenizer(default_vocabulary())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in packed:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    for i, text in rows:
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert [x for p in own for x in p.ids] == [*t.model.encode(text or "", add_special_tokens=False).ids, 1]
        assert own[0].doc_tokens == sum(p.length for p in own)
    total = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own[:-1]]]).tolist()
        total += sum(p.length for p in own)
        assert sum(p.length for p in own) <= 2048
    assert total > 0.96 * 2048 * len(by_sequence)
    made = packing.sequences(spark.createDataFrame(packed)).collect()
    assert all(len(s.ids) == 2048 for s in made) and len(made) == len(by_sequence)


TALK = [("system", ""), ("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]\\ <|end|>\n <|turn|>x < |> \\n"), ("a\nb\\", "z<"), ("assistant", "<")]


def test_chats_are_read_back(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(TALK)] + [(2, 0, None, None), (2, 1, "assistant", None), (None, 0, "assistant", "lost")]
    rows += [(3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "assistant", "é" * 70_000)]
    out = {r.conv_id: r for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in TALK))
    said = "".join(t for r, t in TALK if r == "assistant")
    assert (out[1].loss_chars, out[1].loss_sha256) == (len(said), sha(said))
    assert out[2].n_turns == 2 and out[2].loss_chars == 0 and out[3].n_turns == 2 and out[None].loss_chars == 4 and out[4].loss_chars == 70_000
    assert not any(r.rewrites_history for r in out.values())


def test_no_conversations(spark):
    assert chat.digests(chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn int, role string, text string"))).count() == 0


def test_templates_that_rewrite_history_are_told():
    shorten = lambda turns: "".join(f"[{r}]{t if i == len(turns) - 1 else t[:2]};" for i, (r, t) in enumerate(turns))
    whole, _, texts, rewrites = chat.render(shorten, [("u", "hello"), ("a", "world")])
    assert rewrites and whole[slice(*texts[1])] == "world"
    assert chat.render(chat.default_template, TALK)[3] is False


def test_rollup_commits_once_and_adds_up(spark, tmp_path):
    counts = [(i, f"s{i % 3}" if i % 7 else None, "en", i, 2 * i) for i in range(200)]
    df = spark.createDataFrame(counts, "doc_id bigint, source string, lang string, words bigint, bpe_tokens bigint")
    rollup = tokencounts.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.commit("a", tokencounts.inserts(df, "v1", "words")) and not rollup.commit("a", tokencounts.inserts(df, "v1", "words"))
    rollup.commit("b", tokencounts.deletes(df.where("doc_id % 2 = 0"), "v1", "words"))
    rollup.commit("c", tokencounts.revisions(df.where("doc_id % 4 = 1"), "v1", "words", "v2", "bpe_tokens"))
    # A commit that died half-way leaves no marker; it is written anew.
    (tmp_path / "rollup/deltas/batch=d").mkdir(parents=True)
    assert rollup.batches() == ["a", "b", "c"]
    assert rollup.commit("d", tokencounts.inserts(df.where("false"), "v1", "words")) and not rollup.commit("d", tokencounts.inserts(df, "v1", "words"))
    want_docs, want_tokens = Counter(), Counter()
    for i, source, lang, n, m in counts:
        if i % 2:
            key = (source, lang, "v2" if i % 4 == 1 else "v1")
            want_docs[key] += 1
            want_tokens[key] += m if i % 4 == 1 else n
    got = {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in rollup.totals().collect()}
    assert got == {k: (want_docs[k], want_tokens[k]) for k in want_docs}


def test_token_counts_are_those_of_the_tokenizer(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    t = tokenizer(default_vocabulary())
    for r in tokencounts.count_tokens(df).collect():
        text = TEXTS[r.doc_id] or ""
        assert (r.bpe_tokens, r.words) == (len(t.model.encode(text, add_special_tokens=False).ids), len(re.findall(words.WORD, text)))


def test_scratch_drops(spark):
    s = Scratch(spark, "t")
    table = s.write(spark.range(3).toDF("x"), "x")
    assert table.count() == 3
    s.drop(table)
