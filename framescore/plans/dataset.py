"""From image folders to a labelled table, and from that to a balanced gold table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.functions.names import (
    DAMAGED,
    FLIPPED,
    NOISY as NOISY_ENDING,
    root,
    class_id,
    is_flipped,
    with_ending,
    with_variant,
)
from framescore.operators.combine import join_labels, union_all
from framescore.operators.noise import NOISE_AMOUNT, SALT_SHARE, area_noise, augment_plan, salt_and_pepper
from framescore.operators.pixels import as_image_column, augment, crop_resize, flip
from framescore.operators.sampling import CLASS_TARGETS, FANOUT, balance_classes, fan_out
from framescore.schema import GOLD, IMAGE_TABLE, NO_PATH, validate
from framescore.sources.images import decoded, read_images
from framescore.sources.labels import find_label_file, read_labels
from framescore.sources.tables import read_table, write_table

# The raw classes of the two kinds of source image.
CLEAN, NOISY = "swan", "noisy"

DECODED, REJECTED = "decoded", "rejected"


def small_images(spark: SparkSession, folder: str) -> DataFrame:
    """``name, path, image, status`` with images in stored size, null where rejected."""
    found, good = read_images(spark, folder), decoded(F.col("image"))
    return found.withColumns({
        "image": as_image_column(crop_resize(F.when(good, F.col("image")))),
        "status": F.when(good, DECODED).otherwise(REJECTED),
    })


def ingest(spark: SparkSession, image_dir: str, label_dir: str, noisy_dir: str, out_dir: str) -> DataFrame:
    """Read, crop, label and flip images; returns the written table of all of them.

    Every file is decoded once. Images shrink before they meet the labels, so a label
    table too large to broadcast moves small images and not full frames. The rows of
    files that cannot be decoded go to a partition of their own.
    """
    labels = read_labels(spark, find_label_file(spark, label_dir))
    clean = join_labels(small_images(spark, image_dir), labels)
    noisy = small_images(spark, noisy_dir).withColumn("label", F.lit(NOISY))
    write_table(union_all([clean, noisy]), f"{out_dir}/images_resized", partition_by=["status"])

    resized = read_table(spark, f"{out_dir}/images_resized").where(F.col("status") == DECODED)
    write_table(with_flips(validate(resized, IMAGE_TABLE)), f"{out_dir}/images_final")
    return read_table(spark, f"{out_dir}/images_final", IMAGE_TABLE)


def rejected_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """``name, path`` of the files that ``ingest`` could not decode."""
    resized = read_table(spark, f"{out_dir}/images_resized")
    return resized.where(F.col("status") == REJECTED).select("name", "path")


def with_flips(images: DataFrame) -> DataFrame:
    """Each image and its mirror image, in one scan; an image that is a flip gets none.

    Each image goes to Python once, for its mirror image; the two rows are made after.
    """
    mirrored = images.withColumn("_mirror", flip("horizontal", F.col("image")))
    own_path = F.when(F.col("label").eqNullSafe(NOISY), F.col("path")).otherwise(NO_PATH)
    first = F.struct("name", "path", "image")
    second = F.struct(
        with_ending(F.col("name"), FLIPPED).alias("name"), own_path.alias("path"), F.col("_mirror").alias("image")
    )
    pair = F.when(is_flipped(F.col("name")), F.array(first)).otherwise(F.array(first, second))
    both = mirrored.select("label", F.inline(pair))
    return both.select("name", "path", "label", as_image_column(F.col("image")))


def noisy_images(images: DataFrame, amount: float = NOISE_AMOUNT, salt_share: float = SALT_SHARE) -> DataFrame:
    """Each image with noise patches over a share of its area, as a new image."""
    drawn = area_noise(images, "name", "image", amount, salt_share)
    return drawn.withColumns({"name": with_ending(F.col("name"), NOISY_ENDING), "path": F.lit(NO_PATH)})


def abnormal_images(images: DataFrame) -> DataFrame:
    """Five random variants of each noisy image, and each clean image with noise patches."""
    varied = fan_out(images.where(F.col("label") == NOISY), FANOUT)
    noisy = varied.select(
        with_variant(F.col("name"), F.col("variant")).alias("name"), F.lit(NO_PATH).alias("path"), "label",
        as_image_column(augment(F.col("image"), augment_plan(F.col("name"), F.col("variant")))),
    )
    damaged = salt_and_pepper(images.where(F.col("label") == CLEAN)).select(
        with_ending(F.col("name"), DAMAGED).alias("name"), F.lit(NO_PATH).alias("path"), "label",
        as_image_column(F.col("image")),
    )
    return union_all([noisy, damaged])


def gold(
    spark: SparkSession, images: DataFrame, out_dir: str,
    targets: dict[int, int] = CLASS_TARGETS, exact: bool = False,
) -> DataFrame:
    """Write the training table: about ``targets`` images per class, each its own variant."""
    write_table(abnormal_images(images), f"{out_dir}/images_noisy_final")
    abnormal = read_table(spark, f"{out_dir}/images_noisy_final", IMAGE_TABLE)
    sources = union_all([
        images.where(F.col("label") == CLEAN).withColumn("label", class_id(F.col("label"))),
        abnormal.withColumn("label", class_id(F.lit(NOISY))),
    ])
    copies = balance_classes(sources, targets, exact=exact)
    plan = augment_plan(F.col("source_name"), F.col("variant"))
    # Variants of one frame are told by its name, so that a split can keep them on one side.
    rows = copies.withColumn("image", as_image_column(augment(F.col("image"), plan))).withColumn("source_name", root(F.col("name")))
    write_table(validate(rows, GOLD), f"{out_dir}/gold", partition_by=["label"])
    return read_table(spark, f"{out_dir}/gold", GOLD)
