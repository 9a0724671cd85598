"""Random numbers that are a function of the row.

A number is cut from ``md5(key|variant|purpose)``. The same row draws the same
number in every run, retry and partitioning, and any SQL engine can draw it too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _as_column(part: Column | str | int) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


def draw(*parts: Column | str | int) -> Column:
    """A whole number in [0, 2^32). Plain values are text, columns are cast to text."""
    key = F.concat_ws("|", *[_as_column(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1)."""
    return draw(*parts).cast("double") / F.lit(TWO_32)


def randint(low: Column | int, high: Column | int, *parts: Column | str | int) -> Column:
    """A whole number in [low, high)."""
    low_c = low if isinstance(low, Column) else F.lit(low)
    return low_c + F.pmod(draw(*parts), high - low_c)
