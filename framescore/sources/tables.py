"""Parquet folders and managed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from framescore.operators.combine import only_new
from framescore.schema import validate

# A 256x256 image of three channels is 192 KB, so a file of images stays near 400 MB.
IMAGES_PER_FILE = 2000


def codec(df: DataFrame) -> str:
    """Raw pixels shrink well, and are read more often than written."""
    return "zstd" if "image" in df.columns else "snappy"


def rows_per_file(df: DataFrame) -> int:
    """The bound on rows per file: one for images, none (0) for narrow rows."""
    return IMAGES_PER_FILE if "image" in df.columns else 0


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet folder, with its columns checked where a schema is declared."""
    df = spark.read.parquet(path)
    return validate(df, schema) if schema is not None else df


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Write once, images in files of bounded size; ``partition_by`` lets readers prune classes."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file(df)).option("compression", codec(df))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty table at ``path``, unless there is something already."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(path)


def append_new(spark: SparkSession, incoming: DataFrame, path: str, key: str, order: list[str]) -> None:
    """Append the rows whose key the folder does not hold yet, so a re-run adds nothing."""
    ensure_table(spark, path, incoming.schema)
    known = spark.read.parquet(path).select(key)
    write_table(only_new(incoming, known, key, order), path, mode="append")


def replace_managed(df: DataFrame, table: str) -> None:
    """Write a managed table anew, schema and all."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file(df)).option("compression", codec(df)).saveAsTable(table)


def read_managed(spark: SparkSession, table: str, schema: T.StructType | None = None) -> DataFrame:
    df = spark.table(table)
    return validate(df, schema) if schema is not None else df

