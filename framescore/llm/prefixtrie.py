"""Operator 11: the trie of conversations' turns, with subtree leaves and savings by the Euler-tour technique.

A node is a distinct sequence of turns (role and text) with which some conversation begins; its members are all conversations that
begin so. Training on the trie reads every node's turn once; what that saves in a subtree is each of its nodes' words times the
members beyond the first.

1. ``turn_rows`` reduces every turn to two 64-bit hashes and its number of words. All later tables are that narrow.
2. ``prefixes`` names a sequence of d turns by d and the exclusive or of hashes of (place, turn), a running aggregate within a conversation;
   two sequences share a name with probability 2^-128.
3. ``trie`` groups them to nodes, counted in part before the shuffle, and joins each with its parent. A node with any number of members or
   children is one row.
4. Leaves and savings of all subtrees are prefix sums along one tour of the trie (``eulertour``).
5. ``id_digests`` hashes the ids of the conversations that end at a node: sorted over all tasks, joined to chunks of text there, and only
   the chunks of a node are then streamed through its hash.

Defined cases: rows without a conv_id belong to no conversation and are left out; null roles and texts are empty; turns are ordered with null
first, ties by role, then md5 of the text, and repeated rows are turns of their own; an empty table gives no rows, not even a root;
columns of other names are not read. One conversation's turns are ordered in one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescore.llm.eulertour import subtree_sums
from framescore.llm.scratch import Scratch
from framescore.llm.sqltext import crc32
from framescore.llm.words import WORD

# Ids joined to one chunk of text.
IDS = 1 << 16
NAME = ["depth", "p1", "p2"]


def turn_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, tie, t1, t2, words), one row per turn, without its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint"), "turn", role.alias("role"), F.md5(text).alias("tie"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit("second"), text, role).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )


def _numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.col("turn").asc_nulls_first(), "role", "tie")
    return rows.withColumn("at", F.row_number().over(order))


def _item(at: Column, row: Column | None = None) -> Column:
    field = lambda c: F.col(c) if row is None else row[c]
    return F.struct(at.cast("int").alias("depth"), field("t1").alias("t1"), field("t2").alias("t2"), field("words").alias("words"))


def sequences(turns: DataFrame) -> DataFrame:
    """(block, conv_id, depth, t1, t2, words): every conversation's turns numbered from 1, and a row of depth 0."""
    rows = _numbered(turn_rows(turns).withColumn("block", F.col("conv_id")), ["block"])
    root = F.struct(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("t1"), F.lit(0).cast("bigint").alias("t2"), F.lit(0).cast("bigint").alias("words"))
    items = F.when(F.col("at") == 1, F.array(root, _item(F.col("at")))).otherwise(F.array(_item(F.col("at"))))
    return rows.select("block", "conv_id", F.inline(items))


def rebuilt(turns: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """``sequences`` of rebuilt conversations: conversation c begins with the first h turns of conversation c - c % ``block``,
    then go on with its own turns after its first h; h is the unsigned crc32 of c's decimal digits modulo ``most``.

    All conversations of a block are in one task, so one shuffle serves the numbering and the exchange of turns.
    """
    home = F.col("conv_id") - F.col("conv_id") % block
    rows = _numbered(turn_rows(turns).withColumn("block", home).repartition("block"), ["block", "conv_id"])
    lent = F.when((F.col("conv_id") == F.col("block")) & (F.col("at") < most), F.struct("at", "t1", "t2", "words"))
    rows = rows.withColumn("lent", F.array_sort(F.collect_list(lent).over(Window.partitionBy("block"))))
    rows = rows.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    rows = rows.withColumn("lent", F.filter("lent", lambda x: x["at"] <= F.col("h")))
    root = F.struct(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("t1"), F.lit(0).cast("bigint").alias("t2"), F.lit(0).cast("bigint").alias("words"))
    begin = F.when(F.col("at") == 1, F.concat(F.array(root), F.transform("lent", lambda x: _item(x["at"], x)))).otherwise(F.array())
    own = F.when(F.col("at") > F.col("h"), F.array(_item(F.size("lent") + F.col("at") - F.col("h")))).otherwise(F.array())
    return rows.select("block", "conv_id", F.inline(F.concat(begin, own)))


def prefixes(rows: DataFrame) -> DataFrame:
    """(``NAME``, q1, q2, conv_id, words, ended): every prefix of every sequence, its parent's name, and whether the sequence ends there."""
    order = Window.partitionBy("block", "conv_id").orderBy("depth")
    named = rows.select(
        "block", "conv_id", "depth", "words", *[F.bit_xor(F.xxhash64("depth", f"t{i}")).over(order).alias(f"p{i}") for i in (1, 2)],
    )
    return named.select(
        *NAME, *[F.lag(f"p{i}").over(order).alias(f"q{i}") for i in (1, 2)], "conv_id", "words", F.lead("depth").over(order).isNull().alias("ended")
    )


def id_digests(rows: DataFrame, key: list[str]) -> DataFrame:
    """(``key``, ends_sha256): the hash of all conv_ids of a key, ascending and joined by commas."""
    types = {c: rows.schema[c].dataType.simpleString() for c in key}
    kinds = ", ".join(f"{c} {t}" for c, t in types.items())
    arrow = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[t] for t in types.values()]

    def batch_of(out, more, names):
        columns = zip([*arrow, *more], zip(*out) if out else [()] * (len(arrow) + len(more)))
        return pa.RecordBatch.from_arrays([pa.array(values, kind) for kind, values in columns], [*key, *names])

    def joined(batches):
        at, first, ids = None, None, []
        for batch in batches:
            out = []
            for *own, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if own != at or len(ids) >= IDS:
                    if ids:
                        out.append((*at, first, ",".join(ids)))
                    at, first, ids = own, conv, []
                ids.append(str(conv))
            yield batch_of(out, [pa.int64(), pa.string()], ["first", "ids"])
        if ids:
            yield batch_of([(*at, first, ",".join(ids))], [pa.int64(), pa.string()], ["first", "ids"])

    def hashed(batches):
        at, state = None, None
        for batch in batches:
            out = []
            for *own, _, text in zip(*[c.to_pylist() for c in batch.columns]):
                if own == at:
                    state.update(b"," + text.encode())
                    continue
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = own, hashlib.sha256(text.encode())
            yield batch_of(out, [pa.string()], ["ends_sha256"])
        if at is not None:
            yield batch_of([(*at, state.hexdigest())], [pa.string()], ["ends_sha256"])

    order = [*key, "conv_id"]
    chunks = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, f"{kinds}, first bigint, ids string")
    return chunks.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(hashed, f"{kinds}, ends_sha256 string")


def trie(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per node of the trie of ``sequences``: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.
    """
    made = scratch.write(prefixes(rows), "prefixes")
    nodes = made.groupBy(*NAME).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in ("q1", "q2", "words")]
    )
    nodes = scratch.write(nodes, "nodes")
    # Ids in the order of conversations: the nodes that are new in one conversation are a path, and stay next to each other.
    order = ["conv_id", "depth"]
    named = scratch.write(nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "named")
    above = named.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tree = scratch.write(named.join(above, ["depth", "q1", "q2"], "left"), "tree")
    children = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = scratch.write(tree.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "tree")
    weighed = tree.select(
        "node", "parent", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    )
    sums = subtree_sums(weighed, ["n_leaves", "saved_tokens"], scratch)
    ends = id_digests(made.where("ended"), NAME)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return tree.join(sums, "node").join(ends, NAME, "left").select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


# The same by lists of turns.
ORACLE = r"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS r
    FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY r) AS own FROM turns GROUP BY conv_id),
crcs AS (
    SELECT conv_id, own, """ + crc32("conv_id::VARCHAR") + r""" % 4 AS h
    FROM convs
),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS seq
    FROM crcs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20
),
prefixes AS (
    SELECT conv_id, d, seq[1:d] AS name, d = len(seq) AS ended
    FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)
),
nodes AS (
    SELECT d, name, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256,
           (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(name[d].text, '[^\x20\x09-\x0D]+')) END AS saved
    FROM prefixes GROUP BY d, name
),
children AS (SELECT d - 1 AS d, name[1:d - 1] AS name, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
weighed AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (d, name)),
-- Every node adds to itself and to all nodes above it.
sums AS (
    SELECT up AS d, name[1:up] AS name, sum(saved) AS saved_tokens, sum((n_children = 0)::INT) AS n_leaves
    FROM (SELECT name, saved, n_children, unnest(range(0, d + 1)) AS up FROM weighed) GROUP BY ALL
)
SELECT w.conv_id::BIGINT AS conv_id, w.d::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, w.n_convs::BIGINT AS n_convs,
       w.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM weighed w JOIN sums s USING (d, name) LEFT JOIN nodes p ON p.d = w.d - 1 AND p.name = w.name[1:w.d - 1] AND w.d > 0
"""
