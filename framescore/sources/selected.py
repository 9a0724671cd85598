"""Rows of Parquet files chosen by narrow marks, without moving their other columns.

A row is named by its file and its place in it. A choice of rows, made on narrow columns by any joins and shuffles, becomes one bit
per row: 64 rows of a file share one long. The files are then read where they lie, and each row looks its bit up in a broadcast.
What is broadcast is counted first; a choice above ``BITS_LIMIT`` longs is taken file by file in several passes, each below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Longs of bits broadcast at once, each with the hash of its file and its number: about 64 MB.
BITS_LIMIT = 2_000_000
FILE, ROW = "_file", "_row"


def with_places(rows: DataFrame) -> DataFrame:
    """Rows read from Parquet files, and each one's file and place; also of a stream."""
    return rows.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def _bits(places: DataFrame) -> DataFrame:
    """(file, word, bits): which rows of each 64 of a file are chosen."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col(ROW), F.lit(64)).cast("int"))
    return places.groupBy(F.xxhash64(FILE).alias("_f"), F.shiftright(ROW, 6).alias("_w")).agg(F.bit_or(bit).alias("_bits"))


def _read(spark: SparkSession, files: list[str], like: DataFrame) -> DataFrame:
    # Paths of rows are URIs.
    return spark.read.schema(like.schema).parquet(*[unquote(f) for f in files])


def take_rows(source: DataFrame, places: DataFrame, limit: int = BITS_LIMIT) -> Iterator[DataFrame]:
    """The rows of ``source``'s files at ``places`` (a written table of files and rows), in one or more DataFrames.

    Only files with a chosen row are read. Their list is on the driver, as is that of any folder that Spark reads.
    """
    spark = source.sparkSession
    per_file = places.groupBy(FILE).agg(F.count_distinct(F.shiftright(ROW, 6)).alias("n")).orderBy(FILE).toLocalIterator()
    files, held = [], 0
    for row in per_file:
        if files and held + row["n"] > limit:
            yield _taken(spark, source, places, files)
            files, held = [], 0
        files.append(row[FILE])
        held += row["n"]
    if files:
        yield _taken(spark, source, places, files)


def _taken(spark: SparkSession, source: DataFrame, places: DataFrame, files: list[str]) -> DataFrame:
    # Below the limit, as counted.
    own = F.broadcast(_bits(places.where(F.col(FILE).between(files[0], files[-1]))))
    rows = with_places(_read(spark, files, source))
    same = (F.xxhash64(FILE) == F.col("_f")) & (F.shiftright(ROW, 6) == F.col("_w"))
    chosen = rows.join(own, same).where(F.getbit("_bits", F.pmod(F.col(ROW), F.lit(64)).cast("int")) == 1)
    return chosen.select(*source.columns)
