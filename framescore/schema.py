"""Declared schemas and the checks made against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
])

LABELS = T.StructType([
    T.StructField("image_name", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("notes", T.StringType()),
])

# The struct of Spark's image source: rows of pixels, channels in BGR order.
IMAGE = T.StructType([
    T.StructField("origin", T.StringType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("nChannels", T.IntegerType()),
    T.StructField("mode", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
])

IMAGE_TABLE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("image", IMAGE),
])

GOLD = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("image", IMAGE),
])

LABEL_REPLIES = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("error", T.StringType()),
])

SCORES = T.StructType([
    T.StructField("logits", T.ArrayType(T.DoubleType())),
    T.StructField("probs", T.ArrayType(T.DoubleType())),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("pred_class", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
])

RUNS = T.StructType([
    T.StructField("experiment", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
])

RUN_METRICS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

RUN_INPUTS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("table_name", T.StringType()),
])

# What a stored head needs to score anywhere: a row per class.
HEADS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("class", T.IntegerType()),
    T.StructField("weights", T.ArrayType(T.DoubleType())),
    T.StructField("bias", T.DoubleType()),
    T.StructField("reg", T.DoubleType()),
])

CONFUSION = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("pred_abnormal", T.LongType()),
    T.StructField("pred_normal", T.LongType()),
])

# The class ids, the raw class names and the preview annotation.
ABNORMAL, NORMAL = 0, 1
CLASS_NAMES = {ABNORMAL: "abnormal", NORMAL: "normal"}
RAW_CLASSES = {"noisy": ABNORMAL, "swan": NORMAL}
NO_PATH = "n/a"
IMAGE_METADATA = {"spark.contentAnnotation": '{"mimeType":"image/jpeg"}'}


class SchemaError(ValueError):
    """A table does not have the columns a job declares."""


def _bare(dtype: T.DataType) -> str:
    return dtype.simpleString()


def validate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to ``schema``, or raise naming every missing or mistyped column."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have]
    wrong = [
        f"{f.name}: {_bare(have[f.name])} instead of {_bare(f.dataType)}"
        for f in schema.fields
        if f.name in have and _bare(have[f.name]) != _bare(f.dataType)
    ]
    if missing or wrong:
        raise SchemaError(f"missing columns {missing}, wrong types {wrong}")
    return df.select(*schema.fieldNames())
