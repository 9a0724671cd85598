"""Exact positions inside groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescore.session import cut_lineage


def exact_rank(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in its group.

    ``group + order`` must identify a row. The rows are range-partitioned on group and order, so a large group covers many
    tasks, and are numbered in place; then each (group, range) block is shifted by the rows its group has in
    earlier ranges. The block table has at most one row per group and range, so no group has more blocks to
    sum than there are ranges. One plan for groups of every size.
    """
    keys = [*group, *order]
    placed = cut_lineage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_pos", 33).cast("int")),
        "rank",
    )
    blocks = placed.groupBy(*group, "_range").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_pos").alias("_first")
    )
    earlier = (
        Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1
    block = [*group, "_range"]
    shifts = blocks.select(*[F.col(c).alias(f"_block_{c}") for c in block], shift.alias("_shift"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_block_{c}")) for c in block])
    ranked = placed.join(shifts, same).withColumn(name, F.col("_pos") + F.col("_shift"))
    return ranked.select(*df.columns, name)


def running_totals(df: DataFrame, order: list[str], values: list[str], descending: bool = False) -> DataFrame:
    """Add to each row, as ``until_`` and the value's name, the sum of each value over all rows up to and with it in ``order``.

    ``order`` must identify a row. Ranges of the order are summed each in its own task, and shifted by what the ranges before
    them hold, one row a range; no task sees all rows.
    """
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    placed = cut_lineage(
        df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()).select(*df.columns, "_range"), "totals"
    )
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy(F.col("_range").alias("_block")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    shifts = blocks.select("_block", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_shift_{v}") for v in values])
    summed = placed.withColumns({f"_in_{v}": F.sum(v).over(inside) for v in values})
    joined = summed.join(shifts, F.col("_range") == F.col("_block"))
    return joined.select(*df.columns, *[(F.col(f"_in_{v}") + F.col(f"_shift_{v}")).alias(f"until_{v}") for v in values])
