"""Scoring rows and images as they arrive, with the functions batch jobs use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framescore.functions.indexmaps import MODEL_SIZE
from framescore.operators.scoring import Predict, image_logits, score_table
from framescore.sources.images import decoded, stream_images
from framescore.sources.tables import append_new

FILES_PER_BATCH = 1000


def stream_table(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """A stream over the Parquet files of a folder, old ones first, then new arrivals."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet folder exactly once, all that is available now."""
    return (
        rows.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def score_stream(stream: DataFrame, logits: Column, keep: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Score a stream and append the scores. Rows are independent, so no state is kept."""
    return write_stream(score_table(stream, logits, keep), path, checkpoint)


def score_image_stream(
    spark: SparkSession, folder: str, make_predict: Callable[[], Predict],
    path: str, checkpoint: str, size: int = MODEL_SIZE,
) -> StreamingQuery:
    """Score image files as they land in a folder.

    A file that cannot be decoded comes out too, with null scores and ``ok`` false.
    """
    images = stream_images(spark, folder).withColumn("ok", decoded(F.col("image")))
    return score_stream(images, image_logits(F.col("image"), make_predict, size), ["name", "path", "ok"], path, checkpoint)


def append_new_stream(stream: DataFrame, path: str, key: str, order: list[str], checkpoint: str) -> StreamingQuery:
    """Append the rows of a stream whose key the folder does not hold yet.

    A batch that is replayed after a failure finds its keys there and adds nothing.
    """
    def add(batch: DataFrame, _: int) -> None:
        append_new(batch.sparkSession, batch, path, key, order)

    return (
        stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
