"""Euler tours, list ranking and the trie of conversations against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from framescore.llm import eulertour, prefixtrie
from framescore.llm.scratch import Scratch


@pytest.mark.parametrize("shape", ["random", "path", "star", "one node"])
def test_subtree_sums(spark, shape):
    r = random.Random(3)
    n = 1 if shape == "one node" else 700
    parent = {"random": lambda i: r.randrange(max(0, i - 40), i), "path": lambda i: i - 1, "star": lambda i: 0, "one node": None}[shape]
    tree = [(i, None if i == 0 else parent(i), 1, i * i) for i in range(n)]
    table = spark.createDataFrame(tree, "node bigint, parent bigint, a bigint, b bigint").repartition(5)
    # Small chunks and a short rest, so that contraction and ranking take several rounds.
    got = {s.node: (s.a, s.b) for s in eulertour.subtree_sums(table, ["a", "b"], Scratch(spark, "t"), chunk=16, short=20).collect()}
    want = {i: [1, i * i] for i in range(n)}
    for i in range(n - 1, 0, -1):
        above = want[tree[i][1]]
        above[0], above[1] = above[0] + want[i][0], above[1] + want[i][1]
    assert got == {i: tuple(w) for i, w in want.items()}


def test_places_on_the_tour_are_those_of_a_walk(spark):
    r = random.Random(5)
    tree = [(i, None if i == 0 else r.randrange(i)) for i in range(300)]
    below = defaultdict(list)
    for i, p in tree:
        below[p].append(i)
    walk = []

    def visit(i):
        walk.append(2 * i)
        for j in below[i]:
            visit(j)
        walk.append(2 * i + 1)

    visit(0)
    s = Scratch(spark, "t")
    links = eulertour.arcs(spark.createDataFrame(tree, "node bigint, parent bigint"), [], s)
    for chunk, short in ((1 << 20, 4096), (7, 10)):
        placed = eulertour.positions(links, [], s, chunk, short)
        assert [row.arc for row in placed.orderBy("pos").collect()] == walk


def test_list_rank_of_several_lists(spark):
    items = [(i, i + 1 if i % 100 != 99 else None, i % 3 + 1) for i in range(500)]
    table = spark.createDataFrame(items, "item bigint, next bigint, span bigint").repartition(4)
    got = {row.item: row.start for row in eulertour.list_rank(table, Scratch(spark, "t"), short=30).collect()}
    assert got == {i: sum(j % 3 + 1 for j in range(i // 100 * 100, i)) for i in range(500)}
    assert eulertour.list_rank(table.limit(0), Scratch(spark, "t")).count() == 0


def _conversations(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            text = text or ""
            found[conv].append(((turn is not None, turn or 0), role or "", hashlib.md5(text.encode()).hexdigest(), text))
    return {c: [(t[1], t[3]) for t in sorted(own)] for c, own in found.items()}


def brute(sequences):
    nodes, children, sums = defaultdict(list), defaultdict(list), {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(conv)
    for name in nodes:
        if name:
            children[name[:-1]].append(name)
    for name in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", name[-1][1])) if name else 0
        below = [sums[c] for c in children[name]]
        sums[name] = (sum(b[0] for b in below) or 1, (len(nodes[name]) - 1) * words + sum(b[1] for b in below))
    out = []
    for name, members in nodes.items():
        ends = sorted(c for c in members if len(sequences[c]) == len(name))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members), len(name), min(nodes[name[:-1]]) if name else None, len(members), len(children[name]), *sums[name], digest))
    return sorted(out, key=lambda r: r[:2])


def _rebuilt(own):
    return {c: own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + turns[h:] for c, turns in own.items()}


SCHEMA = "conv_id bigint, turn int, role string, text string, depth int, node string, block string, key int"


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", "b", 2) for r in rows], SCHEMA).repartition(5)


def _rows(seed=11):
    r = random.Random(seed)
    said = ["", "hello there", "a  b\tc", "go on é", None]
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(said)) for c in range(300) if c % 7 for t in range(r.randint(1, 6))]
    # Ties and repeated rows, a null turn, no conv_id, and a common conversation.
    rows += [(40, 1, "user", "tie one"), (40, 1, "user", "tie two"), (41, 2, "user", "again"), (41, 2, "user", "again")]
    rows += [(43, None, "system", "first of all"), (None, 0, "user", "nobody"), (20 * 10**6, 0, "user", "x")]
    return rows + [(c, t, "user", f"common {t}") for c in range(1000, 1400) for t in range(3)]


def test_trie_of_rebuilt_conversations(spark):
    rows = _rows()
    got = prefixtrie.trie(prefixtrie.rebuilt(_table(spark, rows)), Scratch(spark, "t")).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[:2]) == brute(_rebuilt(_conversations(rows)))


def test_trie_of_plain_conversations(spark):
    rows = _rows(12)
    got = prefixtrie.trie(prefixtrie.sequences(_table(spark, rows)), Scratch(spark, "t")).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[:2]) == brute(_conversations(rows))


def test_turnless_conversations_are_members_of_the_root(spark):
    conv = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 1)
    rows = [(conv, 0, "user", "alone"), (60, 0, "user", "b")]
    got = prefixtrie.trie(prefixtrie.rebuilt(_table(spark, rows)), Scratch(spark, "t")).collect()
    root = next(r for r in got if r.depth == 0)
    assert root.n_convs == 2 and root.ends_sha256 == hashlib.sha256(str(conv).encode()).hexdigest()


def test_empty_table(spark):
    assert prefixtrie.trie(prefixtrie.rebuilt(_table(spark, []).where("false")), Scratch(spark, "t")).count() == 0


def test_ids_of_a_large_group_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "IDS", 10)
    rows = spark.range(1000).selectExpr("cast(id % 2 as int) as k", "id * 7919 % 1000 as conv_id")
    got = {r.k: r.ends_sha256 for r in prefixtrie.id_digests(rows, ["k"]).collect()}
    want = {k: ",".join(str(x) for x in sorted(i * 7919 % 1000 for i in range(k, 1000, 2))) for k in (0, 1)}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
