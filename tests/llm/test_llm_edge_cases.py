"""Each operator on odd rows and on an empty table."""

from __future__ import annotations

import pytest
from cases import no_docs, odd_docs, odd_rows

import corpus_pipeline
from framescore.llm import editembed, hostrules, minhash, mixing, packing, passages, sharding, tokencounts
from framescore.llm.scratch import Scratch


def _mix(docs, s):
    rows = s.write(mixing.sized(docs), "sizes")
    return mixing.take(rows, s.write(mixing.source_targets(rows), "targets"))


OPERATORS = {
    "passages": lambda d, s: passages.passages(d, s),
    "sharding": lambda d, s: sharding.with_slots(s.write(sharding.kd_shards(d, s, n_shards=5), "s"), "shard", ["doc_id", "text_crc32"], "slot"),
    "packing": lambda d, s: packing.pack(packing.cut_pieces(d)),
    "rules": lambda d, s: hostrules.judge(d, s),
    "fingerprints": lambda d, s: editembed.next_digests(d),
    "edit classes": lambda d, s: editembed.near_classes(d, s),
    "mixing": _mix,
    "counts": lambda d, s: tokencounts.count_tokens(d),
    "minhash": lambda d, s: minhash.classes(d, s),
}
PER_ROW = ["sharding", "rules", "fingerprints", "edit classes", "mixing", "counts", "minhash"]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table_gives_no_rows(spark, name):
    assert OPERATORS[name](no_docs(spark), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    rows = OPERATORS[name](odd_docs(spark), Scratch(spark, "t")).collect()
    if name in PER_ROW:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows())


def test_documented_results(spark):
    docs, s = odd_docs(spark), Scratch(spark, "t")
    rules = {r.doc_id: r for r in hostrules.judge(docs, s).collect()}
    assert rules[4].n_words == 0 and rules[4].base_failed and not rules[4].kept
    assert rules[11].n_repeat_words == 5 and rules[14].n_dup_lines == 39
    near = {r.doc_id: r.class_id for r in minhash.classes(docs, s).collect()}
    assert near[1] == near[2] == near[13] == 1 and near[9] == near[10] == 9 and near[4] == 4 and near[5] == 5
    prints = {r.doc_id: r for r in editembed.next_digests(docs).collect()}
    assert prints[1].fingerprint == prints[2].fingerprint != prints[3].fingerprint
    found = {(r.doc_id, r.earlier_id) for r in passages.passages(docs, s).collect()}
    assert found == {(2, 1), (13, 2)}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_keep_the_columns(spark, stage, tmp_path):
    docs = odd_docs(spark)
    for table in (docs, no_docs(spark)):
        path = str(tmp_path / f"{stage[0]}-{table is docs}")
        stage[1](spark, table, "").write.parquet(path)
        assert spark.read.parquet(path).columns == docs.columns
