"""Image operators on the pixel struct of Spark's image source.

Each operator is a column: ``df.withColumn("image", flip("horizontal", F.col("image")))``.
Rows go to Python in Arrow batches; images of one size and one operation are
stacked, so NumPy works on the stack and not on single images. Operators that
follow each other in a plan share one trip to Python. Nothing is shuffled.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Hashable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescore.functions.indexmaps import (
    CROP_BIAS,
    SOURCE_OF,
    STORED_SIZE,
    SWAPS_SIDES,
    resize_weights,
    skew_point,
)
from framescore.schema import IMAGE, IMAGE_METADATA

# OpenCV type codes of 8-bit images by channel count, and the
# fraction bits of resize weights.
MODES = {1: 0, 3: 16, 4: 24}
WEIGHT_BITS = 22

Kernel = Callable[[np.ndarray, Hashable], np.ndarray]


def has_pixels(images: pd.DataFrame) -> pd.Series:
    """True for rows whose struct holds a decoded image."""
    return images["data"].notna() & (images["height"].fillna(0).astype(float) > 0)


def on_stacks(images: pd.DataFrame, keys: pd.Series | None, kernel: Kernel) -> pd.DataFrame:
    """Run ``kernel(stack, key)`` on each stack ``[n, h, w, c]`` of one size and key.

    Rows without pixels, files that could not be decoded (height -1) and rows without a key come out as they are.
    """
    out = images.astype(object).where(images.notna(), None).reset_index(drop=True)
    present = out[has_pixels(out)]
    by = [present[c] for c in ("height", "width", "nChannels")]
    if keys is not None:
        by.append(keys.reset_index(drop=True).loc[present.index])
    for group, rows in present.groupby(by, sort=False):
        h, w, c = (int(v) for v in group[:3])
        stack = np.frombuffer(b"".join(rows["data"]), np.uint8).reshape(len(rows), h, w, c)
        result = np.ascontiguousarray(kernel(stack, group[3] if keys is not None else None))
        _, out_h, out_w, out_c = result.shape
        out.loc[rows.index, ["height", "width", "nChannels", "mode"]] = [out_h, out_w, out_c, MODES[out_c]]
        out.loc[rows.index, "data"] = pd.Series([r.tobytes() for r in result], index=rows.index, dtype=object)
    return out


def image_udf(kernel: Kernel) -> Callable[[Column], Column]:
    """An image column function that treats every image alike."""

    @F.pandas_udf(IMAGE)
    def apply(images: pd.DataFrame) -> pd.DataFrame:
        return on_stacks(images, None, kernel)

    return apply


def take(stack: np.ndarray, op: str) -> np.ndarray:
    """A flip or quarter turn by its index map."""
    h, w = stack.shape[1:3]
    out_h, out_w = (w, h) if op in SWAPS_SIDES else (h, w)
    y, x = np.mgrid[:out_h, :out_w]
    sy, sx = SOURCE_OF[op](y, x, h, w)
    return stack[:, sy, sx]


def skew(stack: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Squash and skew to an output of ``size``, linear blending, black surround."""
    h, w, c = stack.shape[1:]
    y, x = np.mgrid[: size[0], : size[1]].astype(float)
    sy, sx = skew_point(y, x, *size)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    sy, sx = sy[inside] - 0.5, sx[inside] - 0.5
    fy, fx = np.floor(sy).astype(int), np.floor(sx).astype(int)
    dy, dx = (sy - fy)[:, None], (sx - fx)[:, None]
    left, right = fx.clip(0, w - 1), (fx + 1).clip(0, w - 1)
    row = fy.clip(0, h - 1)
    below = np.where((fy + 1 >= 0) & (fy + 1 < h), fy + 1, row)
    out = np.zeros((len(stack), *size, c), np.uint8)
    for pixels, drawn in zip(stack.reshape(len(stack), h * w, c), out):
        a, b, d, e = (
            pixels.take(at, axis=0).astype(float)
            for at in (row * w + left, row * w + right, below * w + left, below * w + right)
        )
        upper, lower = a + (b - a) * dx, d + (e - d) * dx
        drawn[inside] = np.floor(upper + (lower - upper) * dy)
    return out


def one_transform(stack: np.ndarray, step: tuple[str, int, int]) -> np.ndarray:
    op, h, w = step
    return take(stack, op) if op in SOURCE_OF else skew(stack, (h, w))


@F.pandas_udf(IMAGE)
def augment(images: pd.DataFrame, plans: pd.Series) -> pd.DataFrame:
    """Apply each row's own list of transforms, as made by ``noise.augment_plan``.

    Images that share the transform of a step are stacked, whatever came before. The
    skew keeps the size an image had before any turn.
    """
    images, ops = images.reset_index(drop=True), [plan.split(">") if plan else [] for plan in plans]
    sizes = list(zip(images["height"], images["width"]))
    for step in range(max(map(len, ops), default=0)):
        todo = [(o[step], *size) if step < len(o) else None for o, size in zip(ops, sizes)]
        images = on_stacks(images, pd.Series(todo, dtype=object), one_transform)
    return images


def _one_axis(stack: np.ndarray, n_out: int, filter_name: str, axis: int) -> np.ndarray:
    """Resize one axis: one pass per neighbour an output pixel draws on, in whole numbers."""
    n_in = stack.shape[axis]
    if n_in == n_out:
        return stack
    shares = np.floor(resize_weights(n_in, n_out, filter_name) * 2**WEIGHT_BITS + 0.5).astype(np.int32)
    first, counts = (shares != 0).argmax(axis=1), (shares != 0).sum(axis=1)
    shape = [1] * stack.ndim
    shape[axis] = n_out
    total = np.int32(2 ** (WEIGHT_BITS - 1))
    for neighbour in range(counts.max()):
        source = np.minimum(first + neighbour, n_in - 1)
        share = np.where(first + neighbour < n_in, shares[np.arange(n_out), source], 0).astype(np.int32)
        total = total + np.take(stack, source, axis) * share.reshape(shape)
    return (total >> WEIGHT_BITS).clip(0, 255).astype(np.uint8)


def resized(stack: np.ndarray, out_h: int, out_w: int, filter_name: str) -> np.ndarray:
    """Nearest, bilinear or cubic; smooth filters round to 8 bits after each axis."""
    if filter_name == "nearest":
        h, w = stack.shape[1:3]
        rows = (2 * np.arange(out_h) + 1) * h // (2 * out_h)
        cols = (2 * np.arange(out_w) + 1) * w // (2 * out_w)
        return stack[:, rows][:, :, cols]
    return _one_axis(_one_axis(stack, out_w, filter_name, 2), out_h, filter_name, 1)


def square(stack: np.ndarray, bias: float | None) -> np.ndarray:
    """The square crop: ``bias`` shifts it sideways, ``None`` centres it."""
    h, w = stack.shape[1:3]
    side = min(h, w)
    if bias is None:
        top, left, bottom, right = (round(v / 2) for v in (h - side, w - side, h + side, w + side))
    else:
        top, left = (h - side) // 2, int((w - side) * bias)
        bottom, right = top + side, left + side
    return stack[:, top:bottom, left:right]


def bgr(stack: np.ndarray) -> np.ndarray:
    """Three channels: grey is repeated, transparency is dropped."""
    return np.repeat(stack, 3, axis=3) if stack.shape[3] == 1 else stack[..., :3]


def flip(direction: str, image: Column) -> Column:
    """``horizontal`` or ``vertical``."""
    return image_udf(lambda stack, _: take(stack, direction))(image)


def rotate(degrees: int, image: Column) -> Column:
    """Counter-clockwise by 90, 180 or 270."""
    return image_udf(lambda stack, _: take(stack, f"rotate_{degrees}"))(image)


def squash_and_skew(image: Column) -> Column:
    return image_udf(lambda stack, _: skew(stack, stack.shape[1:3]))(image)


def to_rgb_channels(image: Column) -> Column:
    return image_udf(lambda stack, _: bgr(stack))(image)


def resize(image: Column, out_h: int, out_w: int, filter_name: str = "bilinear") -> Column:
    return image_udf(lambda stack, _: resized(stack, out_h, out_w, filter_name))(image)


def crop_resize(
    image: Column, size: int = STORED_SIZE, bias: float | None = CROP_BIAS, filter_name: str = "bilinear"
) -> Column:
    """Three channels, square crop, resize: the stored form of an image."""
    return image_udf(lambda stack, _: resized(square(bgr(stack), bias), size, size, filter_name))(image)


def as_image_column(image: Column, name: str = "image") -> Column:
    """Mark a column as an image, so that viewers preview it."""
    return image.alias(name, metadata=IMAGE_METADATA)


def image_from_levels(levels: Column, height: Column | int, width: Column | int) -> Column:
    """A grey image struct from an array of levels 0 to 255, built inside the JVM."""
    digits = F.transform(levels, lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0"))
    as_int = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("int")
    return F.struct(
        F.lit("").alias("origin"), as_int(height).alias("height"), as_int(width).alias("width"),
        F.lit(1).alias("nChannels"), F.lit(MODES[1]).alias("mode"),
        F.unhex(F.concat_ws("", digits)).alias("data"),
    )


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def levels_of(images: pd.DataFrame) -> pd.Series:
    """The pixel bytes of an image as an array of levels."""
    return images["data"].map(lambda d: None if d is None else np.frombuffer(d, np.uint8).astype(np.int32))


def _png(h: int, w: int, c: int, data: bytes) -> bytes:
    pixels = np.frombuffer(data, np.uint8).reshape(h, w, c)
    if c > 1:
        pixels = pixels[..., [2, 1, 0, 3][:c]]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def encode_png(image: Column) -> Column:
    """Image structs as PNG bytes, for export."""

    @F.pandas_udf(T.BinaryType())
    def encode(images: pd.DataFrame) -> pd.Series:
        columns = zip(images["height"], images["width"], images["nChannels"], images["data"])
        return pd.Series([_png(int(h), int(w), int(c), d) if ok else None for ok, (h, w, c, d) in zip(has_pixels(images), columns)])

    return encode(image)


def with_dimensions(df: DataFrame, image: str = "image") -> DataFrame:
    """Add the width and height of each image; no pixel is read."""
    return df.withColumns({"width": F.col(f"{image}.width"), "height": F.col(f"{image}.height")})


def preview(df: DataFrame, n: int = 5, order: str = "name") -> DataFrame:
    """The first ``n`` images by ``order``: names, labels and sizes, no pixels."""
    sized = with_dimensions(df).drop("image")
    return sized.orderBy(order).limit(n)
