"""Steps that keep expensive work from being repeated or crowded into few tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` as a step of its own.

    Unpacking a one-element array gives the same rows as ``withColumn``, but the
    optimizer does not copy the expression into each of its uses, as it does with a
    projection whose fields are read one by one or passed to a Python function.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal narrow rows to all tasks by ``key``, ahead of heavy work on each row; the same plan for tables of any size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
