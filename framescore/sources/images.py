"""Image files as listings, bytes or decoded pixels."""

from __future__ import annotations

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.functions.names import basename
from framescore.schema import IMAGE

# The image extensions a listing takes, in any case.
EXTENSIONS = ("jpg", "jpeg", "png")
IMAGE_GLOB = "*.{%s}" % ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS)
IMAGE_NAME = r"(?i)\.(%s)$" % "|".join(EXTENSIONS)

Folders = str | list[str]


def list_images(spark: SparkSession, folder: Folders, glob: str = IMAGE_GLOB, recursive: bool = False) -> DataFrame:
    """``name, path`` of the image files in one or several folders; no file content is read.

    ``recursive`` takes sub-folders too. The driver holds the list of files of a call, so a very large
    collection is split into folders and ingested in several calls.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", recursive).load(folder)
    )
    return files.select(basename(F.col("path")).alias("name"), "path")


def other_files(spark: SparkSession, folder: Folders, recursive: bool = False) -> DataFrame:
    """``name, path`` of the files that a listing leaves out, so that none goes unseen."""
    return list_images(spark, folder, "*", recursive).where(~F.col("name").rlike(IMAGE_NAME))


def require_images(listing: DataFrame, folder: str) -> DataFrame:
    """The listing sorted by name, or an error when it is empty."""
    if listing.isEmpty():
        raise FileNotFoundError(f"no images found in {folder}")
    return listing.orderBy("name")


def read_image_bytes(spark: SparkSession, folder: Folders, glob: str = IMAGE_GLOB) -> DataFrame:
    """``name, path, content``: the files as they are, for a labeller."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(basename(F.col("path")).alias("name"), "path", "content")


def read_images(spark: SparkSession, folder: Folders, glob: str = IMAGE_GLOB) -> DataFrame:
    """``name, path, image``, decoded by Spark in the JVM.

    A file that cannot be decoded comes out with height -1; see ``valid`` and ``rejects``.
    """
    images = (
        spark.read.format("image").option("dropInvalid", "false")
        .option("pathGlobFilter", glob).load(folder)
    )
    origin = F.col("image.origin")
    return images.select(basename(origin).alias("name"), origin.alias("path"), "image")


def stream_images(spark: SparkSession, folder: str, glob: str = IMAGE_GLOB, files_per_batch: int = 1000) -> DataFrame:
    """The same rows as ``read_images`` for files as they arrive."""
    images = (
        spark.readStream.format("image").schema(f"image {IMAGE.simpleString()}")
        .option("dropInvalid", "false").option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch).load(folder)
    )
    origin = F.col("image.origin")
    return images.select(basename(origin).alias("name"), origin.alias("path"), "image")


def decoded(image: Column) -> Column:
    """True where the file could be decoded."""
    return image["height"] > 0


def valid(images: DataFrame) -> DataFrame:
    return images.where(decoded(F.col("image")))


def rejects(images: DataFrame) -> DataFrame:
    """The files that could not be decoded."""
    return images.where(~decoded(F.col("image"))).select("name", "path")


def write_files(files: DataFrame, folder: str) -> int:
    """Write ``name, content`` rows as files of a folder, each by the task that holds it; the number of files.

    A file of that name is replaced, so a task that is run again does no harm. For images: ``pixels.encode_png``.
    """

    def write(batches):
        store, base = FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(*[c.to_pylist() for c in batch.columns]):
                with store.open_output_stream(f"{base}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = files.where("name IS NOT NULL AND content IS NOT NULL").select("name", "content")
    return rows.mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
