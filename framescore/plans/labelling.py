"""Label a folder of images and keep labels and failures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framescore.functions.names import basename
from framescore.operators.labelling import failed_images, label_images, normalise_labels, parse_replies
from framescore.schema import LABEL_REPLIES
from framescore.sources.images import IMAGE_GLOB, list_images, read_image_bytes, require_images
from framescore.sources.labels import write_labels_csv, write_labels_json
from framescore.sources.tables import read_table, write_table


# The columns of Spark's source of whole files.
CONTENTS = "path string, modificationTime timestamp, length bigint, content binary"


def label_folder(
    spark: SparkSession, image_dir: str, labeller: Callable[[bytes], str], out_dir: str,
    parallelism: int | None = None,
) -> DataFrame:
    """Label every image, replace earlier outputs, and return the failed images.

    The replies are written before anything else reads them. A task that is lost is run again, and sends its images
    again; ``label_stream`` commits in slices, and takes up where a broken run ended. Below ``out_dir``: ``replies``, ``csv``, ``json``, ``failed``.
    """
    require_images(list_images(spark, image_dir), image_dir)
    write_table(label_images(read_image_bytes(spark, image_dir), labeller, parallelism), f"{out_dir}/replies")
    parsed = parse_replies(read_table(spark, f"{out_dir}/replies", LABEL_REPLIES))
    labels = normalise_labels(parsed.where(F.col("ok")))
    write_labels_csv(labels, f"{out_dir}/csv")
    write_labels_json(labels, f"{out_dir}/json")
    write_table(failed_images(parsed), f"{out_dir}/failed")
    return read_table(spark, f"{out_dir}/failed")


def label_stream(
    images: DataFrame, labeller: Callable[[bytes], str], path: str, checkpoint: str, in_flight: int = 8
) -> StreamingQuery:
    """Label a stream of ``name, content`` slice by slice, all that is there and has no reply yet; the replies go to ``path``.

    A slice is a micro-batch: its size is set where the stream is read (files per trigger). Its images are sent by ``in_flight`` tasks, which
    read them where they lie, so that many calls run at once. Its replies are committed once, by the file sink's log. A run that is
    broken off costs the calls of its open slice; the next one begins with that slice and sends no image of the
    others again. Files that arrive later are the slices of later runs.
    """
    replies = label_images(images.select("name", "content"), labeller, in_flight)
    return (
        replies.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_contents(spark: SparkSession, folder: str, slice_size: int = 200) -> DataFrame:
    """The image files of a folder as a stream of ``name, path, content``, ``slice_size`` files a micro-batch, the oldest first."""
    files = (
        spark.readStream.format("binaryFile").schema(CONTENTS).option("pathGlobFilter", IMAGE_GLOB)
        .option("maxFilesPerTrigger", slice_size).load(folder)
    )
    return files.select(basename(F.col("path")).alias("name"), "path", "content")


def unanswered(spark: SparkSession, path: str) -> DataFrame:
    """The replies that are failures, to be sent again by a run of their own."""
    return read_table(spark, path, LABEL_REPLIES).where(~F.col("ok")).select("name", "error")
