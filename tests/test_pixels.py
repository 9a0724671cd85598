"""Exact results and algebra of the pixel operators."""

from __future__ import annotations

import numpy as np
import pytest
from pictures import arrays, noise, ramp, table
from pyspark.sql import functions as F

from framescore.functions import grid
from framescore.functions.indexmaps import resize_weights
from framescore.operators import pixels


def apply(spark, array, op):
    return arrays(table(spark, {"a": array}).withColumn("image", op(F.col("image"))))["a"]


def test_flips_and_turns_are_numpys(spark):
    a = ramp()
    assert (apply(spark, a, lambda i: pixels.flip("horizontal", i)) == a[:, ::-1]).all()
    assert (apply(spark, a, lambda i: pixels.flip("vertical", i)) == a[::-1]).all()
    for turns, degrees in enumerate((90, 180, 270), 1):
        assert (apply(spark, a, lambda i, d=degrees: pixels.rotate(d, i)) == np.rot90(a, turns)).all()


@pytest.mark.parametrize("plan", [
    "horizontal>horizontal", "vertical>vertical", "rotate_90>rotate_270",
    "rotate_90>rotate_90>rotate_90>rotate_90", "rotate_180>rotate_180", "",
])
def test_compositions_that_cancel(spark, plan):
    a = ramp()
    assert (apply(spark, a, lambda i: pixels.augment(i, F.lit(plan))) == a).all()


def test_rows_follow_their_own_plan(spark):
    a = noise(20, 12)
    plans = ["horizontal", "rotate_90>vertical", "", "vertical>rotate_90", "rotate_180"]
    df = table(spark, {p: a for p in plans}).coalesce(1)
    got = arrays(df.withColumn("image", pixels.augment(F.col("image"), F.col("name"))))
    assert (got["horizontal"] == a[:, ::-1]).all()
    assert (got["rotate_90>vertical"] == np.rot90(a)[::-1]).all()
    assert (got["vertical>rotate_90"] == np.rot90(a[::-1])).all()
    assert (got[""] == a).all()
    assert (got["rotate_180"] == a[::-1, ::-1]).all()


def test_skew_after_a_turn_has_the_first_size(spark):
    got = apply(spark, noise(20, 12), lambda i: pixels.augment(i, F.lit("rotate_90>squash&skew")))
    assert got.shape == (20, 12, 3)


def test_skew_by_brute_force(spark):
    a = noise(10, 14)
    h, w, _ = a.shape
    got = apply(spark, a, pixels.squash_and_skew)
    expected = np.zeros_like(a)
    for y in range(h):
        for x in range(w):
            sx = (x + 0.5) + 0.3 * (y + 0.5) - 0.15 * w
            sy = 0.3 * (x + 0.5) + (y + 0.5) - 0.15 * h
            if not (0 <= sx < w and 0 <= sy < h):
                continue
            x0, y0 = int(np.floor(sx - 0.5)), int(np.floor(sy - 0.5))
            dx, dy = sx - 0.5 - x0, sy - 0.5 - y0
            at = lambda yy, xx: a[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)].astype(float)
            top = at(y0, x0) * (1 - dx) + at(y0, x0 + 1) * dx
            low = at(y0 + 1, x0) * (1 - dx) + at(y0 + 1, x0 + 1) * dx if 0 <= y0 + 1 < h else top
            expected[y, x] = np.floor(top * (1 - dy) + low * dy + 1e-9)
    assert np.abs(got.astype(int) - expected).max() <= 1


@pytest.mark.parametrize(("h", "w"), [(360, 640), (640, 360), (20, 20)])
def test_stored_form(spark, h, w):
    got = apply(spark, noise(h, w), lambda i: pixels.crop_resize(i, 256))
    assert got.shape == (256, 256, 3)


def test_biased_crop(spark):
    a = ramp(6, 9)
    got = apply(spark, a, lambda i: pixels.crop_resize(i, 6))
    assert (got == a[:, 1:7]).all()  # int((9 - 6) * 0.40) = 1


def test_tall_images_keep_their_middle(spark):
    a = ramp(9, 6)
    assert (apply(spark, a, lambda i: pixels.crop_resize(i, 6)) == a[1:7]).all()


@pytest.mark.parametrize(("h", "w", "top", "left", "bottom", "right"), [
    (4, 8, 0, 2, 4, 6), (3, 6, 0, 2, 3, 4), (5, 8, 0, 2, 5, 6), (9, 4, 2, 0, 6, 4),
])
def test_centre_crop_rounds_halves_to_even(spark, h, w, top, left, bottom, right):
    a = noise(h, w)
    box = spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(grid.centre_box(h, w))]).first()
    assert tuple(box) == (top, left, bottom, right)
    assert (pixels.square(a[None], None)[0] == a[top:bottom, left:right]).all()


def test_nearest_takes_whole_pixels(spark):
    a = ramp(4, 4)
    doubled = apply(spark, a, lambda i: pixels.resize(i, 8, 8, "nearest"))
    assert (doubled == a.repeat(2, 0).repeat(2, 1)).all()
    assert (apply(spark, doubled, lambda i: pixels.resize(i, 4, 4, "nearest")) == a).all()


def test_bilinear_halving_by_hand():
    # Halving widens the triangle to two cells either side: shares 1 3 3 1, of 8.
    weights = resize_weights(8, 4, "bilinear")
    assert np.allclose(weights[1], [0, 1 / 8, 3 / 8, 3 / 8, 1 / 8, 0, 0, 0])
    assert np.allclose(weights[0], np.array([3, 3, 1, 0, 0, 0, 0, 0]) / 7)


@pytest.mark.parametrize("name", ["bilinear", "cubic"])
@pytest.mark.parametrize(("n_in", "n_out"), [(8, 4), (4, 8), (7, 5), (360, 256), (256, 224)])
def test_resize_shares_sum_to_one(name, n_in, n_out):
    assert np.allclose(resize_weights(n_in, n_out, name).sum(axis=1), 1)


@pytest.mark.parametrize("name", ["nearest", "bilinear", "cubic"])
def test_flat_images_stay_flat(spark, name):
    a = np.full((30, 41, 3), 93, np.uint8)
    assert (apply(spark, a, lambda i: pixels.resize(i, 17, 50, name)) == 93).all()


def test_channels(spark):
    grey, rgba = noise(5, 6, 1), noise(5, 6, 4)
    assert (apply(spark, grey, pixels.to_rgb_channels) == grey.repeat(3, 2)).all()
    assert (apply(spark, rgba, pixels.to_rgb_channels) == rgba[..., :3]).all()


def test_batches_of_mixed_sizes_and_missing_images(spark):
    shapes = {"a": noise(5, 6), "b": noise(9, 4), "c": noise(5, 6, 1), "d": noise(5, 6, seed=9)}
    df = table(spark, shapes).unionByName(
        table(spark, {"e": noise(5, 6)}).withColumn("image", F.lit(None).cast(table(spark, shapes).schema["image"].dataType))
    ).coalesce(1)
    got = df.withColumn("image", pixels.flip("vertical", F.col("image")))
    assert got.where("image.data is null").count() == 1
    for name, array in arrays(got.where("image.data is not null")).items():
        assert (array == shapes[name][::-1]).all()


def test_chained_operators_share_one_trip_to_python(spark):
    df = table(spark, {"a": ramp()})
    chained = pixels.flip("vertical", pixels.resize(pixels.to_rgb_channels(F.col("image")), 8, 8))
    plan = df.select(chained.alias("image"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_grid_and_pixel_maps_agree(spark):
    a = ramp(5, 7, 1)
    flat = F.lit(a.ravel().tolist())
    for op in grid.SOURCE_OF:
        cells = spark.range(1).select(grid.transform(flat, op, 5, 7).alias("g")).first().g
        assert cells == pixels.take(a[None], op)[0].ravel().tolist()


def test_preview_metadata_survives_in_the_schema(spark):
    df = table(spark, {"a": ramp()}).withColumn("image", pixels.as_image_column(F.col("image")))
    assert df.schema["image"].metadata == {"spark.contentAnnotation": '{"mimeType":"image/jpeg"}'}
