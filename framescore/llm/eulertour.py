"""The Euler-tour technique on trees of any size: arcs, distributed list ranking, prefix sums at arc positions.

A tour enters every node once and leaves it once. The arc after entering a node enters its first child, or leaves the node; the arc
after leaving it enters its next sibling, or leaves the parent. So the arcs are one linked list per tree.

1. ``arcs`` builds the list: children are numbered by ``exact_rank``, so a node with very many children is spread over tasks, and each
   is joined with the one numbered next.
2. ``positions`` ranks it. Arcs of nodes that are neighbours in the order of ids are contracted in place: within a chunk of ids,
   every maximal stretch of the list becomes one item. The items are ranked by ``list_rank``: in each round every item draws a coin, and one that
   draws 1 takes in its successor if that drew 0, so a quarter of them go, until few are left; then places are handed back,
   round by round. The work is linear in the number of arcs.
3. ``running_sums`` adds values up in the order of positions, and ``subtree_sums`` takes the difference over each node's two arcs.

Tables are written where later steps read them several times. Defined cases: an empty table gives no rows; several trees are ranked apart, each
from 0 (sums over their subtrees are still right); a node whose parent is not in the table is an error of the caller.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescore.llm.scratch import Scratch
from framescore.operators.ranking import exact_rank

# Nodes whose arcs are contracted together in memory.
CHUNK = 1 << 20
# A list of at most so many items is ranked by walking along it in one task.
SHORT = 4096


def arcs(tree: DataFrame, values: list[str], scratch: Scratch) -> DataFrame:
    """(node, after_enter, after_exit, ``values``) of ``tree`` (node, parent, ``values``), siblings in the order of their ids.

    Ids are longs from 0 to 2^62; the arc into a node is 2 * node, the one out of it 2 * node + 1. The last arc has none after it.
    """
    ranked = scratch.write(exact_rank(tree.select("node", "parent", *values), ["parent"], ["node"], "_rank"), "ranked")
    following = ranked.where("parent IS NOT NULL").select(F.col("parent").alias("_p"), (F.col("_rank") - 1).alias("_r"), F.col("node").alias("_next"))
    first = ranked.where("parent IS NOT NULL").groupBy(F.col("parent").alias("_of")).agg(F.min("node").alias("_first"))
    linked = ranked.join(following, (F.col("parent") == F.col("_p")) & (F.col("_rank") == F.col("_r")), "left")
    linked = linked.join(first, F.col("node") == F.col("_of"), "left")
    return linked.select(
        "node",
        F.coalesce(F.col("_first") * 2, F.col("node") * 2 + 1).alias("after_enter"),
        F.coalesce(F.col("_next") * 2, F.col("parent") * 2 + 1).alias("after_exit"),
        *values,
    )


def _contract(node: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
    """(head, offset, span, next) of each arc: the stretch of the list it lies in, as far as all its arcs are of these nodes.

    ``after`` holds the arcs after entering and leaving each node in turn, -1 for none. Ends of stretches are found by pointer doubling.
    """
    n = len(after)
    at = np.minimum(np.searchsorted(node, after >> 1), len(node) - 1)
    inside = (after >= 0) & (node[at] == after >> 1)
    end = np.where(inside, 2 * at + (after & 1), np.arange(n))
    steps = inside.astype(np.int64)
    while True:
        further = end[end]
        if np.array_equal(further, end):
            break
        steps, end = steps + steps[end], further
    begins = np.ones(n, bool)
    begins[(2 * at + (after & 1))[inside]] = False
    heads = np.flatnonzero(begins)
    head_of = np.zeros(n, np.int64)
    head_of[end[heads]] = heads
    head = head_of[end]
    return head, steps[head] - steps, steps[head] + 1, after[end]


def _chunks(batches, size: int):
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def contracted(links: DataFrame, values: list[str], chunk: int = CHUNK) -> DataFrame:
    """(arc, head, offset, span, next, ``values``): span and next are given for heads only, ``values`` are 0 on the way out."""

    def run(batches):
        for table in _chunks(batches, chunk):
            columns = [c.to_numpy() for c in table.combine_chunks().itercolumns()]
            node, own = columns[0], columns[3:]
            after = np.stack([columns[1], columns[2]], axis=1).reshape(-1)
            head, offset, span, following = _contract(node, after)
            arc = (2 * node[:, None] + np.arange(2)).reshape(-1)
            inner = offset > 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(arc), pa.array(arc[head]), pa.array(offset), pa.array(span, mask=inner), pa.array(following, mask=inner | (following < 0)),
                    *(pa.array(np.stack([v, np.zeros_like(v)], axis=1).reshape(-1)) for v in own),
                ],
                ["arc", "head", "offset", "span", "next", *values],
            )

    none = F.coalesce("after_exit", F.lit(-1)).alias("after_exit")
    rows = links.select("node", "after_enter", none, *[F.col(v).cast("bigint").alias(v) for v in values])
    kinds = "".join(f", {v} bigint" for v in values)
    return rows.repartitionByRange("node").sortWithinPartitions("node").mapInArrow(run, f"arc bigint, head bigint, offset bigint, span bigint, next bigint{kinds}")


def list_rank(items: DataFrame, scratch: Scratch, short: int = SHORT) -> DataFrame:
    """(item, start): how much span lies before each item of the linked lists ``items`` (item, next, span)."""
    left, rounds = items.select("item", "next", "span"), []
    while left.count() > short:
        turn = len(rounds)
        coin = lambda c, t=turn: F.xxhash64(c, F.lit(t)) % 2 == 0
        takes = coin("item") & F.col("next").isNotNull() & ~coin("next")
        givers = left.where(~coin("item")).select(F.col("item").alias("gone"), F.col("next").alias("_next"), F.col("span").alias("_span"))
        # Each taker meets its successor; those that drew 0 and meet no taker stay.
        met = left.where(takes).join(givers, F.col("next") == F.col("gone"), "full").select(
            F.coalesce("item", "gone").alias("item"), F.col("_next").alias("next"), (F.coalesce("span", F.lit(0)) + F.col("_span")).alias("span"),
            F.when(F.col("item").isNotNull(), F.col("gone")).alias("gone"), F.col("span").alias("before"),
        )
        alone = left.where(coin("item") & ~takes).select("item", "next", "span", F.lit(None).cast("bigint").alias("gone"), F.lit(None).cast("bigint").alias("before"))
        made = scratch.write(met.unionByName(alone), "round")
        rounds.append(made.where("gone IS NOT NULL").select("gone", F.col("item").alias("owner"), "before"))
        left = made.select("item", "next", "span")
    known = scratch.write(left.repartition(1).mapInPandas(_walk, "item bigint, start bigint"), "starts")
    for gone in reversed(rounds):
        own = gone.join(known, F.col("owner") == F.col("item")).select(F.col("gone").alias("item"), (F.col("start") + F.col("before")).alias("start"))
        known = scratch.write(known.unionByName(own), "starts")
    return known


def _walk(frames):
    """The starts of the few items that are left."""
    rows = pd.concat([*frames, pd.DataFrame({"item": [], "next": [], "span": []})])
    after = {int(i): (None if pd.isna(n) else int(n), int(s)) for i, n, s in zip(rows["item"], rows["next"], rows["span"])}
    out = []
    for item in after.keys() - {n for n, _ in after.values()}:
        start = 0
        while item is not None:
            out.append((item, start))
            item, span = after[item]
            start += span
    yield pd.DataFrame(out, columns=["item", "start"])


def positions(links: DataFrame, values: list[str], scratch: Scratch, chunk: int = CHUNK, short: int = SHORT) -> DataFrame:
    """(arc, pos, ``values``): each arc's place in its tour, from 0."""
    chains = scratch.write(contracted(links, values, chunk), "chains")
    starts = list_rank(chains.where("span IS NOT NULL").select(F.col("arc").alias("item"), "next", "span"), scratch, short)
    placed = chains.join(starts, F.col("head") == F.col("item"))
    return placed.select("arc", (F.col("start") + F.col("offset")).alias("pos"), *values)


def running_sums(placed: DataFrame, values: list[str], scratch: Scratch) -> DataFrame:
    """``placed`` (arc, pos, values) with each value replaced by its sum up to and with the row, in the order of pos and arc.

    Ranges of positions are summed in place and then shifted by what the ranges before them hold: one row a range.
    """

    def run(batches):
        total = np.zeros(len(values), np.int64)
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            sums = [np.cumsum(c) + t for c, t in zip(columns[2:], total)]
            if batch.num_rows:
                total = np.array([s[-1] for s in sums], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, sums), *batch.columns[2:]], ["arc", "part", *values, *(f"_{v}" for v in values)])

    own = "".join(f", {v} bigint" for v in values) + "".join(f", _{v} bigint" for v in values)
    dealt = placed.select("arc", "pos", *values).repartitionByRange("pos", "arc").sortWithinPartitions("pos", "arc")
    numbered = dealt.select("arc", F.spark_partition_id().cast("bigint").alias("part"), *values)
    made = scratch.write(numbered.mapInArrow(run, f"arc bigint, part bigint{own}"), "running")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = made.groupBy("part").agg(*[F.sum(f"_{v}").alias(f"_{v}") for v in values])
    shifts = totals.select(F.col("part").alias("_part"), *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_s{v}") for v in values])
    return made.join(shifts, F.col("part") == F.col("_part")).select(
        "arc", *[(F.col(v) + F.col(f"_s{v}")).alias(v) for v in values], *[F.col(f"_{v}") for v in values]
    )


def subtree_sums(tree: DataFrame, values: list[str], scratch: Scratch, chunk: int = CHUNK, short: int = SHORT) -> DataFrame:
    """(node, ``values``): each value of ``tree`` (node, parent, values) summed over the node and all below it."""
    placed = positions(arcs(tree, values, scratch), values, scratch, chunk, short)
    sums = running_sums(placed, values, scratch)
    way_out = F.col("arc") % 2 == 1
    # What the tour holds up to the way out, less what it held before the way in.
    over = lambda v: F.sum(F.when(way_out, F.col(v)).otherwise(F.col(f"_{v}") - F.col(v)))
    return sums.groupBy(F.shiftright("arc", 1).alias("node")).agg(*[over(v).alias(v) for v in values])
