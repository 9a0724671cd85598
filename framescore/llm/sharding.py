"""Operator 2: shards by k-d tree partitioning.

Documents are points in metadata space. A node that holds several shards' bytes is cut along its widest dimension
(its range over the range of all documents) at the weighted median of its documents' bytes; a node of an odd
number of shards is cut at the matching quantile. The tree grows a level at a time, all nodes of a level in one
pass over narrow rows. A cut is found by refining an interval: bytes per node and bin are summed before the shuffle,
the bin that holds the quantile becomes the interval, and so on until the bin weighs less than the tolerance.

Dimensions are whole numbers: numeric columns as they are, text columns as a hash, so any number of distinct values
is fine. Below each value lie 32 bits of the text's hash and 16 of the document's, so ties (one source
with a third of all rows, thousands of equal texts) are cut anywhere, copies of a text staying next to each other.

The driver holds one row per node, that is a table of the number of shards; ``MAX_SHARDS`` guards its size and is
also the bound on what is broadcast.

Defined cases: a null text weighs 8 bytes; a null dimension is a value of its own, before all others; equal rows
are points of one place, dealt by the order of the cut; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescore.llm.scratch import Scratch

MAX_SHARDS = 100_000
BINS = 1024
# A cut may miss its quantile by this share of a shard's bytes (and by one document).
TOLERANCE = 0.001
_TIE_BITS = 32

NODE = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("cut", T.LongType()),
    T.StructField("left", T.LongType()), T.StructField("right", T.LongType()),
])


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8


def points(docs: DataFrame, dims: list[str]) -> DataFrame:
    """(doc_id, size, text_crc32, d0, d1, ...): a dimension's value in the upper bits, the tie hash below."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tie = F.shiftrightunsigned(F.xxhash64(text, F.col("doc_id")), 64 - _TIE_BITS // 2)
    copies = F.shiftrightunsigned(F.xxhash64(text), 64 - _TIE_BITS // 2)
    low = F.shiftleft(copies, _TIE_BITS // 2).bitwiseOR(tie)
    columns = []
    for i, name in enumerate(dims):
        kind = docs.schema[name].dataType
        value = F.col(name).cast("bigint") if isinstance(kind, T.NumericType) else F.crc32(F.col(name).cast("binary")).cast("bigint") % (1 << 30)
        value = F.least(F.greatest(value, F.lit(-(1 << 30))), F.lit((1 << 30) - 1))
        columns.append(F.shiftleft(F.coalesce(value, F.lit(-(1 << 30) - 1)), _TIE_BITS).bitwiseOR(low).alias(f"d{i}"))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), *columns,
    )


class _Tree:
    """Cuts by level, and the leaves' shard numbers."""

    def __init__(self, spark: SparkSession, dims: int):
        self.spark, self.dims, self.levels = spark, dims, []

    def key(self, dim: Column) -> Column:
        out = F.col("d0")
        for i in range(1, self.dims):
            out = F.when(dim == i, F.col(f"d{i}")).otherwise(out)
        return out

    def place(self, rows: DataFrame) -> DataFrame:
        """Add node: the path through all levels so far. Each level's table is at most MAX_SHARDS rows."""
        out = rows.withColumn("node", F.lit(0).cast("bigint"))
        for cuts in self.levels:
            table = self.spark.createDataFrame(cuts, NODE).withColumnRenamed("node", "_node")
            side = F.when(self.key(F.col("dim")) <= F.col("cut"), F.col("left")).otherwise(F.col("right"))
            out = out.join(F.broadcast(table), F.col("node") == F.col("_node"), "left")
            out = out.withColumn("node", F.when(F.col("_node").isNull(), F.col("node")).otherwise(side)).select(*rows.columns, "node")
        return out


def kd_shards(docs: DataFrame, scratch: Scratch, n_shards: int | None = None, target_bytes: int | None = None, dims=("source", "lang", "n_chars")) -> DataFrame:
    """(doc_id, size, text_crc32, shard): shards 0 to n - 1 of near-equal bytes.

    Give the number of shards, or the bytes at which leaves stop, from which the number follows.
    """
    spark = docs.sparkSession
    dims = [d for d in dims if d in docs.columns]
    rows = scratch.write(points(docs, dims), "points")
    tree = _Tree(spark, len(dims))
    ranges = [F.min(f"d{i}").alias(f"lo{i}") for i in range(len(dims))] + [F.max(f"d{i}").alias(f"hi{i}") for i in range(len(dims))]
    whole = rows.agg(F.sum("size").alias("total"), *ranges).first()
    total = whole["total"] or 0
    n = n_shards or max(1, math.ceil(total / target_bytes))
    if n > MAX_SHARDS:
        raise ValueError(f"{n} shards; at most {MAX_SHARDS}")
    spans = [max(1, (whole[f"hi{i}"] or 0) - (whole[f"lo{i}"] or 0)) for i in range(len(dims))]
    open_nodes, next_node, leaves = {0: (0, n)}, 1, {}
    while open_nodes and total:
        leaves |= {k: v[0] for k, v in open_nodes.items() if v[1] == 1}
        open_nodes = {k: v for k, v in open_nodes.items() if v[1] > 1}
        if not open_nodes:
            break
        placed = tree.place(rows)
        stats = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("size").alias("total"), *ranges).collect()}
        active = {}
        for node, (_, count) in open_nodes.items():
            s = stats.get(node)
            if s is None:
                continue
            dim = max(range(len(dims)), key=lambda i: ((s[f"hi{i}"] - s[f"lo{i}"]) / spans[i], -i))
            goal = s["total"] * (count // 2) / count
            active[node] = [dim, s[f"lo{dim}"], s[f"hi{dim}"], 0, goal]
        cuts = _quantiles(placed, tree, active, TOLERANCE * total / n)
        level, grown = [], {}
        for node, (first, count) in open_nodes.items():
            left, right, next_node = next_node, next_node + 1, next_node + 2
            dim, cut = cuts.get(node, (0, 0))
            level.append((node, dim, cut, left, right))
            grown[left], grown[right] = (first, count // 2), (first + count // 2, count - count // 2)
        tree.levels.append(level)
        open_nodes = grown
    numbers = spark.createDataFrame([(k, v) for k, v in leaves.items()] or [(0, 0)], "_leaf bigint, shard int")
    return tree.place(rows).join(F.broadcast(numbers), F.col("node") == F.col("_leaf")).select("doc_id", "size", "text_crc32", "shard")


def _quantiles(placed: DataFrame, tree: _Tree, active: dict, tolerance: float) -> dict[int, tuple[int, int]]:
    """Per node the dimension and the greatest key of its left part: a radix search on summed bytes.

    ``active``: node -> [dimension, interval's ends, bytes before the interval, bytes wanted on the left].
    """
    found = {}
    spark = placed.sparkSession
    while active:
        table = spark.createDataFrame([(k, d, lo, hi) for k, (d, lo, hi, _, _) in active.items()], "_node bigint, dim int, lo bigint, hi bigint")
        key = tree.key(F.col("dim"))
        # hi - lo may pass 2^63, so the bin's width is taken in decimals and never below 1.
        width = F.greatest(F.lit(1), F.ceil((F.col("hi").cast("decimal(38,0)") - F.col("lo") + 1) / BINS)).cast("bigint")
        inside = (
            placed.join(F.broadcast(table.withColumn("width", width)), F.col("node") == F.col("_node"))
            .withColumn("key", key).where((F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi")))
            .withColumn("bin", F.floor((F.col("key") - F.col("lo")) / F.col("width")))
        )
        bins = inside.groupBy("node", "bin").agg(F.sum("size").alias("size"), F.max("key").alias("top"), F.min("key").alias("low"), F.max("lo").alias("lo"))
        running = Window.partitionBy("node").orderBy("bin")
        goals = spark.createDataFrame([(k, float(g - b)) for k, (_, _, _, b, g) in active.items()], "_node bigint, goal double")
        # One row per node reaches the driver: the first bin whose running sum meets the goal.
        crossing = (
            bins.withColumn("upto", F.sum("size").over(running)).join(F.broadcast(goals), F.col("node") == F.col("_node"))
            .where(F.col("upto") >= F.col("goal")).groupBy("node").agg(F.min(F.struct("bin", "upto", "size", "low", "top")).alias("c"))
        )
        hit = {r["node"]: r["c"] for r in crossing.collect()}
        still = {}
        for node, (dim, lo, hi, before, goal) in active.items():
            c = hit.get(node)
            if c is None:
                found[node] = (dim, hi)
                continue
            reached = before + c["upto"]
            if c["low"] == c["top"] or c["size"] <= tolerance:
                # Take the border bin to the nearer side.
                near = reached - goal <= goal - (reached - c["size"])
                found[node] = (dim, c["top"] if near else c["low"] - 1)
            else:
                still[node] = [dim, c["low"], c["top"], reached - c["size"], goal]
        active = still
    return found


def with_slots(rows: DataFrame, group: str, order: list[str], name: str, chunks: int = 256) -> DataFrame:
    """Number the rows of each group from 0 without a gap, a group spread over ``chunks`` tasks.

    Rows are dealt to chunks by hash, counted per chunk before the shuffle, and numbered inside their chunk.
    ``rows`` is read twice: it should be a written table.
    """
    dealt = rows.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    earlier = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(F.col(group).alias("_g"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(group, "_chunk").orderBy(*order)
    return (
        dealt.withColumn("_at", F.row_number().over(inside) - 1)
        .join(starts, (F.col(group) == F.col("_g")) & (F.col("_chunk") == F.col("_c")))
        .select(*rows.columns, (F.col("_at") + F.col("_first")).cast("bigint").alias(name))
    )
