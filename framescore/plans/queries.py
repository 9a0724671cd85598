"""The query catalogue over the test tables.

``documents`` stands for an image listing, ``labels`` for the label file,
``embeddings`` for 8x8 images, ``events`` for frames, runs and replies. Every query
reads its tables whole.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescore.functions import grid, jsonio, names
from framescore.functions.probability import linear_logits, with_scores
from framescore.functions.staging import spread
from framescore.operators import (
    combine,
    evaluate,
    head,
    labelling,
    noise,
    pixels,
    runlog,
    sampling,
    scoring,
    tensors,
    thresholds,
)
from framescore.plans import model
from framescore.schema import ABNORMAL, NO_PATH, NORMAL
from framescore.session import new_shared_path, ship_package
from framescore.streaming.score import score_stream, stream_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SIDE = 8
CELLS = SIDE * SIDE
# File names of the tables' images end in these in turn.
EXTENSIONS = (".jpg", ".JPG", ".png", ".jpeg")
SCHEME = "lake"
RATES = [0.0, 0.01, 0.05, 0.25, 1.0]
THRESHOLDS = [0.1, 0.25, 0.5, 0.75, 0.9]
HEAD = [[((7 * i + 13 * c) % 11 - 5) / 2 for i in range(CELLS)] for c in range(2)]
NO_BIAS = [0.0, 0.0]
TARGETS = {NORMAL: 2000, ABNORMAL: 1100}
BIG = 64
FPS = 4.9
NOISE_SUMMARY = T.StructType([T.StructField(n, T.LongType()) for n in ("black", "white", "weighed")])


def query(build: Query) -> Query:
    """Register ``build`` under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extension(number: Column) -> Column:
    """File names of a table have four extensions."""
    return F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.pmod(number, F.lit(len(EXTENSIONS))) + 1).cast("int"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), extension(F.col("doc_id")))
    path = F.concat(F.lit(f"{SCHEME}:/images/"), name)
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), path.alias("path"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "labels").select(stem.alias("image_name"), F.col("quality").alias("label"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.join_labels(images(spark, sf_dir), labels(spark, sf_dir))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, name, label, grid``: classes below 2 are abnormal."""
    label = F.when(F.col("label") < 2, ABNORMAL).otherwise(NORMAL)
    name = F.concat(F.lit("vec_"), F.col("vec_id").cast("string"), extension(F.col("vec_id")))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", name.alias("name"), label.alias("label"), F.col("embedding").alias("grid")
    )


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grids as grey images of 8x8 pixels."""
    levels = grid.to_bytes(F.col("grid"), -1.0, 1.0)
    return spread(grids(spark, sf_dir), "vec_id").select(
        "vec_id", "name", "label", pixels.image_from_levels(levels, SIDE, SIDE).alias("image")
    )


def big_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grids enlarged to 64x64 pixels."""
    big = pixels.resize(F.col("image"), BIG, BIG, "nearest")
    return pictures(spark, sf_dir).withColumn("image", big)


def scored_rows(rows: DataFrame) -> DataFrame:
    return with_scores(rows.withColumn("logits", linear_logits(F.col("grid"), HEAD, NO_BIAS)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_rows(grids(spark, sf_dir))


def r6(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), 6)


def cells(df: DataFrame, values: Column, *keep: str) -> DataFrame:
    """One row per cell of an array column."""
    return df.select(*keep, F.posexplode(values).alias("k", "value")).withColumn("value", r6("value"))


def pixel_rows(df: DataFrame, image: Column, *keep: str) -> DataFrame:
    done = df.select(*keep, image.alias("image"))
    return done.select(
        *keep, F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.posexplode(pixels.levels_of(F.col("image"))).alias("k", "value"),
    )


# --- listings, labels and names ---------------------------------------------------


@query
def label_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("name", "label")


@query
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = combine.label_counts(images(spark, sf_dir), labels(spark, sf_dir))
    return counts.agg(
        F.sum(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0)).alias("labelled"),
        F.sum(F.when(F.col("label").isNull(), F.col("n")).otherwise(0)).alias("unlabelled"),
    )


@query
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.label_counts(images(spark, sf_dir), labels(spark, sf_dir))


@query
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.row_counts(grids(spark, sf_dir))


@query
def distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.distinct_labels(table(spark, sf_dir, "embeddings"))


@query
def num_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.label_cardinality(table(spark, sf_dir, "embeddings"))


@query
def filter_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).where(F.col("label") == NORMAL).select("name", "label")


def flipped(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "name": names.with_ending(F.col("name"), names.FLIPPED), "path": F.lit(NO_PATH),
    })


@query
def variant_guard_rlike(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = images(spark, sf_dir)
    every = combine.union_all([base, flipped(base)])
    return every.where(~names.is_flipped(F.col("name"))).select("name")


@query
def rename_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return images(spark, sf_dir).select(
        "name",
        names.with_ending(name, names.FLIPPED).alias("flipped"),
        names.with_ending(name, names.TRANSPOSED).alias("transposed"),
        names.with_ending(name, names.DAMAGED).alias("damaged"),
    )


@query
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("class_name", names.class_name(F.col("label")))
    text = names.label_to_text(F.col("label"))
    return rows.select(
        "name", "class_name", names.class_id(F.col("class_name")).alias("class_id"),
        text.alias("label_text"), names.text_to_label(text).alias("label_back"),
        names.text_to_label(F.col("class_name")).alias("not_a_number"),
    )


@query
def path_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("name", names.mount_path(F.col("path"), SCHEME).alias("path"))


@query
def path_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = images(spark, sf_dir).select("path")
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    return combine.union_all([listed, pages]).select(
        "path", names.basename(F.col("path")).alias("base"), names.stem(F.col("path")).alias("stem")
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeller replies made from events: two label keys, some fenced, some broken."""
    kind, props = F.col("event_type"), F.col("props")
    key = F.when(kind == "click", "animal").otherwise("label")
    document = F.concat(
        F.lit('{"'), key, F.lit('": "'), kind, F.lit('", "notes": "'),
        F.get_json_object(props, "$.k"), F.lit('"}'),
    )
    raw = (
        F.when(kind == "error", F.concat(F.lit("no label: "), props))
        .when(kind == "view", F.concat(F.lit("Here it is:\n```json\n"), document, F.lit("\n```\nDone.")))
        .otherwise(F.concat(F.lit(" \n"), document, F.lit("\n ")))
    )
    name = F.concat(F.lit("event_"), F.col("event_id").cast("string"), F.lit(".jpg"))
    return spread(table(spark, sf_dir, "events"), "event_id").select(
        name.alias("name"), raw.alias("raw"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error")
    )


@query
def fenced_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies(spark, sf_dir).select("name", jsonio.fenced_json(F.col("raw")).alias("document"))


@query
def label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = labelling.parse_replies(replies(spark, sf_dir)).where("ok")
    return labelling.normalise_labels(parsed)


@query
def label_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.label_summary(labelling.parse_replies(replies(spark, sf_dir)))


@query
def label_failed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.failed_images(labelling.parse_replies(replies(spark, sf_dir)))


def odd_length_refused(content: bytes) -> str:
    """A labeller."""
    if len(content) % 2:
        raise ValueError(f"odd length {len(content)}")
    return '```json\n{"animal": "text", "notes": "%d"}\n```' % len(content)


@query
def bulk_labelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as file contents, read by a labeller that refuses some of them."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    files = table(spark, sf_dir, "documents").select(
        name.alias("name"), F.col("text").cast("binary").alias("content")
    )
    return labelling.parse_replies(labelling.label_images(files, odd_length_refused))


@query
def base64_data_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = jsonio.data_url(F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(url).cast("bigint").alias("n"), F.md5(url).alias("digest")
    )


# --- unions, duplicates and runs ----------------------------------------------------


@query
def union_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = images(spark, sf_dir)
    return combine.union_all([base, flipped(base), base.select("path", "name", "doc_id")]).select("name", "path")


@query
def union_missing_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = images(spark, sf_dir).select("name", "path")
    right = combine.label_keys(labels(spark, sf_dir)).withColumnRenamed("stem", "name")
    return combine.union_all([left, right], allow_missing=True)


@query
def dedup_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = images(spark, sf_dir).select("name", "path")
    twice = combine.union_all([base.withColumn("source", F.lit(s)) for s in (1, 0)])
    return combine.dedup(twice, "name", ["path", "source"])


@query
def append_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = labelled(spark, sf_dir).where(F.col("label").isNotNull()).select("name")
    incoming = images(spark, sf_dir).select("name", "path")
    return combine.only_new(incoming, known, "name", ["path"])


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("experiment"),
        F.col("event_id").alias("run_id"), F.col("event_type").alias("status"), F.col("ts").alias("start_time"),
    )


def iso(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query
def recent_runs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.recent_runs(runs(spark, sf_dir)).withColumn("start_time", iso("start_time"))


@query
def experiment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.experiments(runs(spark, sf_dir))


@query
def run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runlog.experiment_runs(runs(spark, sf_dir), "user_8")
    return found.withColumn("start_time", iso("start_time"))


@query
def preview_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.preview(pictures(spark, sf_dir), 5, "vec_id")


@query
def image_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.with_dimensions(pictures(spark, sf_dir)).select("name", "width", "height")


@query
def class_sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grids(spark, sf_dir).select("vec_id", "label")
    return combine.union_all([sampling.sample_class(rows, c, 5, "vec_id") for c in (NORMAL, ABNORMAL)])


# --- splits and balance -------------------------------------------------------------


@query
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_split(grids(spark, sf_dir)).select("name", "label", "split")


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(grids(spark, sf_dir))


@query
def stratified_split_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the ranking for classes too large for one task."""
    return sampling.stratified_split(grids(spark, sf_dir))


@query
def split_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.split_counts(sampling.hash_split(grids(spark, sf_dir)))


@query
def split_class_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.split_class_sums(sampling.hash_split(grids(spark, sf_dir)))


@query
def variant_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    abnormal = grids(spark, sf_dir).where(F.col("label") == ABNORMAL)
    return sampling.fan_out(abnormal, sampling.FANOUT).select(
        names.with_variant(F.col("name"), F.col("variant")).alias("name"), F.lit(NO_PATH).alias("path"), "variant"
    )


@query
def class_balance_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grids(spark, sf_dir).select("name", "label")
    return sampling.balance_classes(rows, TARGETS)


@query
def class_balance_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grids(spark, sf_dir).select("name", "label")
    return sampling.balance_classes(rows, TARGETS, exact=True)


@query
def class_balance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = sampling.class_repetitions(grids(spark, sf_dir), TARGETS)
    return reps.withColumn("n_out", F.col("n_source") * F.col("reps"))


@query
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    kept = sampling.stride_sample(frames, "user_id", ["ts", "event_id"], sampling.frame_step(F.lit(FPS)))
    return kept.select("user_id", "event_id", "frame_no", "frame_name")


@query
def stride_sample_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the ranking for sources too large for one task."""
    frames = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    step = sampling.frame_step(F.lit(FPS))
    kept = sampling.stride_sample(frames, "user_id", ["ts", "event_id"], step)
    return kept.select("user_id", "event_id", "frame_no", "frame_name")


@query
def stride_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as frames that know their position."""
    frames = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return sampling.stride_by_index(frames, "turn", sampling.frame_step(F.lit(1.25)))


# --- grids --------------------------------------------------------------------------


@query
def grid_flip_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(grids(spark, sf_dir), grid.flip_horizontal(F.col("grid"), SIDE, SIDE), "vec_id")


@query
def grid_flip_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(grids(spark, sf_dir), grid.flip_vertical(F.col("grid"), SIDE, SIDE), "vec_id")


@query
def grid_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter turns of the grid read as 4 rows of 16."""
    turns = F.array(*[
        F.struct(F.lit(d).alias("degrees"), grid.rotate(F.col("grid"), d, 4, 16).alias("turned"))
        for d in (90, 180, 270)
    ])
    rows = grids(spark, sf_dir).select("vec_id", F.inline(turns))
    return cells(rows, F.col("turned"), "vec_id", "degrees")


def _crops(spark: SparkSession, sf_dir: str, box: Callable) -> DataFrame:
    """Square crops of the grid read as 4x16 and as 16x4."""
    views = F.array(*[
        F.struct(F.lit(h).alias("height"), F.lit(w).alias("width"),
                 grid.crop(F.col("grid"), box(h, w), w).alias("cropped"))
        for h, w in ((4, 16), (16, 4))
    ])
    rows = grids(spark, sf_dir).select("vec_id", F.inline(views))
    return cells(rows, F.col("cropped"), "vec_id", "height", "width")


@query
def grid_crop_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crops(spark, sf_dir, grid.biased_box)


@query
def grid_crop_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crops(spark, sf_dir, grid.centre_box)


@query
def grid_resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(grids(spark, sf_dir), grid.resize_nearest(F.col("grid"), SIDE, SIDE, 5, 11), "vec_id")


@query
def grid_resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spread(grids(spark, sf_dir), "vec_id"), grid.resize_smooth(F.col("grid"), SIDE, SIDE, 5, 11), "vec_id")


@query
def grid_resize_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spread(grids(spark, sf_dir), "vec_id"), grid.resize_smooth(F.col("grid"), SIDE, SIDE, 5, 11, "cubic"), "vec_id")


@query
def grid_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spread(grids(spark, sf_dir), "vec_id"), grid.squash_and_skew(F.col("grid"), SIDE, SIDE), "vec_id")


# --- pixels -------------------------------------------------------------------------


@query
def pixel_flip_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = sampling.fan_out(pictures(spark, sf_dir), 5)
    op = F.element_at(F.lit(list(grid.SOURCE_OF)), F.col("variant") + 1)
    rows = every.withColumn("op", op)
    return pixel_rows(rows, pixels.augment(F.col("image"), F.col("op")), "vec_id", "op")


@query
def pixel_resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_rows(pictures(spark, sf_dir), pixels.resize(F.col("image"), 5, 11, "bilinear"), "vec_id")


@query
def pixel_resize_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_rows(pictures(spark, sf_dir), pixels.resize(F.col("image"), 5, 11, "cubic"), "vec_id")


@query
def pixel_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_rows(pictures(spark, sf_dir), pixels.squash_and_skew(F.col("image")), "vec_id")


@query
def pixel_crop_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid as 4 rows of 16 in three equal channels, cropped and enlarged to 6x6."""
    levels = grid.to_bytes(F.col("grid"), -1.0, 1.0)
    wide = grids(spark, sf_dir).withColumn("image", pixels.image_from_levels(levels, 4, 16))
    return pixel_rows(wide, pixels.crop_resize(F.col("image"), 6), "vec_id")


@query
def pixel_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two random compositions of every picture."""
    rows = sampling.fan_out(pictures(spark, sf_dir), 2)
    plan = noise.augment_plan(F.col("name"), F.col("variant"))
    return pixel_rows(rows, pixels.augment(F.col("image"), plan), "vec_id", "variant")


@F.pandas_udf(NOISE_SUMMARY)
def _summary(images: pd.DataFrame) -> pd.DataFrame:
    """Black and white pixels of each image, and a sum that depends on where they are."""
    levels = [np.frombuffer(d, np.uint8).astype(np.int64) for d in images["data"]]
    return pd.DataFrame({
        "black": [(v == noise.PEPPER).sum() for v in levels],
        "white": [(v == noise.SALT).sum() for v in levels],
        "weighed": [(v * np.arange(1, len(v) + 1)).sum() for v in levels],
    })


def _noise_summary(df: DataFrame) -> DataFrame:
    return df.select("vec_id", _summary(F.col("image")).alias("s")).select("vec_id", "s.*")


@query
def pixel_salt_pepper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noise_summary(noise.salt_and_pepper(big_pictures(spark, sf_dir)))


@query
def pixel_area_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noise_summary(noise.area_noise(big_pictures(spark, sf_dir), amount=0.1))


@query
def augment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.fan_out(grids(spark, sf_dir), sampling.FANOUT)
    return rows.select("name", "variant", noise.augment_plan(F.col("name"), F.col("variant")).alias("ops"))


@query
def noise_patch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = noise.patch_plan(F.col("name"), 256, 320)
    return grids(spark, sf_dir).select("name", F.inline(plan))


@query
def noise_polygon_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = noise.patch_plan(F.col("name"), 256, 320)
    drawn = noise.with_polygons(plan, F.col("name"))
    rows = grids(spark, sf_dir).select("name", F.posexplode(drawn).alias("patch", "p"))
    points = rows.select("name", "patch", "p.level", F.posexplode("p.points").alias("vertex", "point"))
    return points.select("name", "patch", "level", "vertex", "point.x", "point.y")


@query
def noise_area_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = noise.area_plan(F.col("name"), 256, 320)
    return grids(spark, sf_dir).select("name", F.inline(plan)).drop("level")


# --- tensors, messages and scores ---------------------------------------------------


@query
def tensor_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(grids(spark, sf_dir), grid.rescale(grid.to_bytes(F.col("grid"), -1.0, 1.0)), "vec_id")


@query
def tensor_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = grid.rescale(grid.to_bytes(F.col("grid"), -1.0, 1.0))
    return cells(grids(spark, sf_dir), grid.normalise(levels), "vec_id")


@query
def tensor_chw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(grids(spark, sf_dir), grid.to_chw(F.col("grid"), 4, 4, 4), "vec_id")


@query
def pixel_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures as model inputs: three channels, 12x12, normalised."""
    rows = pictures(spark, sf_dir).select("vec_id", tensors.to_tensor(F.col("image"), 12).alias("t"))
    return cells(rows, F.col("t"), "vec_id")


@query
def image_model_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures through preprocessing and a model in one step: 8x8, the head on each channel."""
    loader = scoring.linear_predict([row * 3 for row in HEAD], NO_BIAS)
    logits = scoring.image_logits(F.col("image"), loader, SIDE)
    rows = pictures(spark, sf_dir).select("vec_id", logits.alias("logits"))
    return rows.select("vec_id", r6(F.col("logits")[0]).alias("z0"), r6(F.col("logits")[1]).alias("z1"))


@query
def noisy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    paths = combine.union_all([
        images(spark, sf_dir).select("name"), table(spark, sf_dir, "pages").select(F.col("url").alias("name")),
    ])
    return paths.select("name", names.with_ending(name, names.NOISY).alias("noisy"))


@query
def score_payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in both forms, read back: batch size, shape and values."""
    values = F.transform("grid", lambda v: v.cast("double"))
    rows = grids(spark, sf_dir).select(
        "vec_id", jsonio.instances_request(values, [1, SIDE, SIDE]).alias("a"),
        jsonio.tensor_request(values, [1, SIDE, SIDE]).alias("b"),
    )
    back = rows.select(
        "vec_id", F.from_json("a", jsonio.INSTANCES_SCHEMA)["instances"].alias("instances"),
        F.from_json("b", jsonio.TENSOR_SCHEMA)["inputs"]["tensor"].alias("tensor"),
    )
    instance = F.flatten(F.flatten(F.col("instances")[0])).alias("instance")
    pairs = F.arrays_zip(instance, F.col("tensor.values").alias("flat"))
    return back.select(
        "vec_id", F.size("instances").alias("batch"), F.array_join("tensor.shape", "x").alias("shape"),
        F.posexplode(pairs).alias("k", "p"),
    ).select("vec_id", "batch", "shape", "k", r6("p.instance").alias("instance"), r6("p.flat").alias("flat"))


@query
def score_response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = F.col("value").cast("string"), F.get_json_object("props", "$.k")
    # One to three predictions in a reply.
    one = F.concat(F.lit("["), first, F.lit(", "), second, F.lit("]"))
    count = (F.pmod(F.col("event_id"), F.lit(3)) + 1).cast("int")
    body = F.concat(F.lit('{"predictions": ['), F.array_join(F.array_repeat(one, count), ", "), F.lit("]}"))
    rows = jsonio.explode_predictions(table(spark, sf_dir, "events").select("event_id", body.alias("body")), F.col("body"))
    return rows.select("event_id", "position", r6(F.col("logits")[0]).alias("z0"), r6(F.col("logits")[1]).alias("z1"))


@query
def linear_head_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a model object in Python, as for any other model."""
    logits = scoring.vector_logits(F.col("grid"), scoring.linear_predict(HEAD, NO_BIAS), CELLS)
    rows = grids(spark, sf_dir).select("vec_id", logits.alias("logits"))
    return rows.select("vec_id", r6(F.col("logits")[0]).alias("z0"), r6(F.col("logits")[1]).alias("z1"))


@query
def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(
        "vec_id", r6(F.col("probs")[0]).alias("p0"), r6(F.col("probs")[1]).alias("p1"),
        r6("anomaly_score").alias("anomaly_score"),
    )


@query
def predict_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("vec_id", "label", "pred_class", r6("confidence").alias("confidence"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() == "double" else f.name
                       for f in df.schema.fields])


@query
def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.score_stats(scored(spark, sf_dir)))


@query
def sampled_score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of the first 50 rows of each class."""
    rows = grids(spark, sf_dir)
    sample = combine.union_all([sampling.sample_class(rows, c, 50, "vec_id") for c in (NORMAL, ABNORMAL)])
    return _rounded(evaluate.score_stats(scored_rows(sample)))


@query
def score_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a scoring service, made from events, as scores."""
    first = (F.col("value") / 50).cast("string")
    second = (F.get_json_object("props", "$.k").cast("double") / 25).cast("string")
    body = F.concat(F.lit('{"predictions": [['), first, F.lit(", "), second, F.lit("]]}"))
    rows = jsonio.explode_predictions(table(spark, sf_dir, "events").select("event_id", body.alias("body")), F.col("body"))
    done = scoring.score_table(rows, F.col("logits"), ["event_id"])
    return done.select(
        "event_id", r6("anomaly_score").alias("anomaly_score"), "pred_class", r6("confidence").alias("confidence")
    )


@query
def score_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.score_separation(scored(spark, sf_dir)))


@query
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.threshold_sweep(scored(spark, sf_dir), THRESHOLDS))


@query
def f1_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.f1_scores(scored(spark, sf_dir)))


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_matrix(scored(spark, sf_dir))


@query
def baseline_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.prior_baseline(sampling.hash_split(grids(spark, sf_dir))))


@query
def head_fit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the train split, score the rest. No SQL form: the fit is iterative."""
    rows = sampling.hash_split(grids(spark, sf_dir).withColumnRenamed("grid", "features"))
    fitted = head.fit_head(rows.where(F.col("split") == "train"))
    held_out = head.predict(rows.where(F.col("split") == "eval"), fitted)
    return held_out.select("vec_id", "label", "pred_class", r6("anomaly_score").alias("anomaly_score"))


@query
def train_and_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pictures to a report: damage a copy of each, fit a head, score the held-out rows.

    No SQL form: the fit is iterative.
    """
    clean = big_pictures(spark, sf_dir).select("name", "image", F.lit(NORMAL).alias("label"))
    damaged = noise.salt_and_pepper(clean).withColumns({
        "name": names.with_ending(F.col("name"), names.DAMAGED), "label": F.lit(ABNORMAL),
    })
    rows = model.training_rows(combine.union_all([clean, damaged]))
    fitted, rows = model.train(
        spark, rows, new_shared_path(spark, "runs"), "report", "1", datetime(2024, 1, 1), "pictures",
    )
    scores = model.score(rows.where(F.col("split") == "eval"), fitted, ["name", "label"])
    return _rounded(evaluate.score_stats(scores))


@query
def threshold_at_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest thresholds that keep to some false-alarm rates, over the order of all scores."""
    rows = scored(spark, sf_dir).select("label", r6("anomaly_score").alias("anomaly_score"))
    found = thresholds.threshold_at_rate(rows, RATES)
    return found.withColumns({c: r6(c) for c in ("false_alarm_rate", "miss_rate")})


@query
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream, scored into a table of the shared folder."""
    stream = stream_table(spark, f"{sf_dir}/{{embeddings.parquet}}")  # a pattern: it may be one file
    out = new_shared_path(spark, "scores")
    logits = linear_logits(F.col("embedding"), HEAD, NO_BIAS)
    score_stream(stream, logits, ["vec_id"], out, new_shared_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).select(
        "vec_id", r6("anomaly_score").alias("anomaly_score"), "pred_class", r6("confidence").alias("confidence")
    )


@query
def anomaly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: score every row, then the statistics and hits of each class in one pass."""
    hits = F.count_if(F.col("label") == F.col("pred_class")).alias("n_right")
    return _rounded(scored(spark, sf_dir).groupBy("label").agg(*evaluate.score_columns(), hits))
