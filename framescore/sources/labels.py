"""Label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescore.schema import LABELS

# How a label file is recognised, in any case.
LABEL_FILE_SUFFIX = "labels.csv"

LABEL_DOCUMENT = T.MapType(T.StringType(), T.StructType([
    T.StructField("animal", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("notes", T.StringType()),
]))


def find_label_file(spark: SparkSession, folder: str) -> str:
    """The path of the label file in a folder, the first by name when there are several."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    found = files.where(F.lower("path").endswith(LABEL_FILE_SUFFIX)).agg(F.min("path")).first()[0]
    if found is None:
        raise FileNotFoundError(f"no {LABEL_FILE_SUFFIX} found under {folder}")
    return found


def read_labels(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A label CSV with the declared header; another header or a broken row is an error.

    A quote inside a quoted field is doubled. ``multi_line`` allows line breaks in
    notes, at the price that one task reads the whole file.
    """
    return (
        spark.read.schema(LABELS).option("header", True).option("enforceSchema", False)
        .option("escape", '"').option("multiLine", multi_line).option("mode", "FAILFAST").csv(path)
    )


def read_label_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents keyed by image stem, one row per image.

    A document is one value, read by one task: a form for import. Tables of labels are kept as JSON lines or Parquet.
    """
    documents = spark.read.text(path, wholetext=True)
    entries = documents.select(F.explode(F.from_json("value", LABEL_DOCUMENT)).alias("image_name", "entry"))
    return entries.select(
        "image_name", F.coalesce("entry.label", "entry.animal").alias("label"), "entry.notes"
    )


def read_labels_json(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_labels_json`` writes: one object per line, so a file is read by many tasks."""
    return spark.read.schema(LABELS).option("mode", "FAILFAST").json(path)


def write_labels_csv(labels: DataFrame, path: str) -> None:
    """Labels with a header and every field quoted; an earlier run's output is replaced."""
    writer = labels.select(*LABELS.names).write.mode("overwrite").option("header", True)
    writer.option("quoteAll", True).option("escape", '"').csv(path)


def write_labels_json(labels: DataFrame, path: str) -> None:
    """Labels with one JSON object per line; an earlier run's output is replaced."""
    labels.select(*LABELS.names).write.mode("overwrite").json(path)
