"""Image operators on small images held as flat arrays, row by row.

These stay inside Catalyst and suit thumbnails and feature grids of a few hundred
cells; whole images go through ``framescore.operators.pixels``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from framescore.functions.indexmaps import (
    CROP_BIAS,
    SOURCE_OF,
    SWAPS_SIDES,
    resize_weights,
    skew_point,
)


def div(a: Column | int, b: Column | int) -> Column:
    """Whole-number division."""
    return F.call_function("div", _col(a), _col(b)).cast("int")


def _col(v: Column | int | float) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def number_array(values: list) -> Column:
    """Numbers, or lists of numbers, as one literal array of doubles."""
    def text(v: list | float) -> str:
        return f"array({', '.join(map(text, v))})" if isinstance(v, list) else f"{float(v)!r}D"

    return F.expr(text(values))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` loops over it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cells(height: Column | int, width: Column | int, cell: Callable[[Column, Column], Column]) -> Column:
    """An array of ``height * width`` cells, each made from its row and column."""
    h, w = _col(height), _col(width)
    return F.transform(
        F.sequence(F.lit(0), (h * w - 1).cast("int")), lambda k: cell(div(k, w), F.pmod(k, w).cast("int"))
    )


def _at(grid: Column, y: Column, x: Column, width: Column | int) -> Column:
    return F.get(grid, (y * _col(width) + x).cast("int"))


def transform(grid: Column, op: str, height: int, width: int) -> Column:
    """A flip or quarter turn; the sides swap for 90 and 270 degrees."""
    h, w = (width, height) if op in SWAPS_SIDES else (height, width)

    def cell(y: Column, x: Column) -> Column:
        sy, sx = SOURCE_OF[op](y, x, height, width)
        return sy * width + sx

    return let(grid, lambda g: _cells(h, w, lambda y, x: F.get(g, cell(y, x).cast("int"))))


def flip_horizontal(grid: Column, height: int, width: int) -> Column:
    return transform(grid, "horizontal", height, width)


def flip_vertical(grid: Column, height: int, width: int) -> Column:
    return transform(grid, "vertical", height, width)


def rotate(grid: Column, degrees: int, height: int, width: int) -> Column:
    """A counter-clockwise turn by 90, 180 or 270 degrees."""
    return transform(grid, f"rotate_{degrees}", height, width)


def biased_box(height: Column | int, width: Column | int, bias: float = CROP_BIAS) -> tuple[Column, Column, Column, Column]:
    """``top, left, bottom, right`` of the square crop, shifted sideways by ``bias``."""
    h, w = _col(height), _col(width)
    side = F.least(h, w)
    top = div(h - side, 2)
    left = F.floor((w - side) * F.lit(bias)).cast("int")
    return top, left, top + side, left + side


def centre_box(height: Column | int, width: Column | int) -> tuple[Column, Column, Column, Column]:
    """The centred square crop; halves round to the even neighbour on every edge."""
    h, w = _col(height), _col(width)
    side = F.least(h, w)

    def edge(v: Column) -> Column:
        return F.bround(v / 2, 0).cast("int")

    return edge(h - side), edge(w - side), edge(h + side), edge(w + side)


def crop(grid: Column, box: tuple[Column, Column, Column, Column], width: Column | int) -> Column:
    top, left, bottom, right = box
    return let(grid, lambda g: _cells(
        bottom - top, right - left, lambda y, x: _at(g, top + y, left + x, width)
    ))


def nearest_index(i: Column, n_in: int, n_out: int) -> Column:
    """``floor((i + 0.5) * n_in / n_out)`` in whole numbers."""
    return div((i * 2 + 1) * n_in, 2 * n_out)


def resize_nearest(grid: Column, height: int, width: int, out_h: int, out_w: int) -> Column:
    return let(grid, lambda g: _cells(
        out_h, out_w,
        lambda y, x: _at(g, nearest_index(y, height, out_h), nearest_index(x, width, out_w), width),
    ))


def _dot(size: int, term: Callable[[Column], Column]) -> Column:
    return F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(size - 1)), term), F.lit(0.0), lambda acc, v: acc + v
    )


def resize_smooth(grid: Column, height: int, width: int, out_h: int, out_w: int, filter_name: str = "bilinear") -> Column:
    """Separable resize, rows first; the filter widens when the image shrinks."""
    across = number_array(resize_weights(width, out_w, filter_name).tolist())
    down = number_array(resize_weights(height, out_h, filter_name).tolist())
    rows = let(grid, lambda g: _cells(
        height, out_w,
        lambda y, x: _dot(width, lambda j: _at(g, y, j, width).cast("double") * F.get(F.get(across, x), j)),
    ))
    return let(rows, lambda r: _cells(
        out_h, out_w,
        lambda y, x: _dot(height, lambda j: _at(r, j, x, out_w) * F.get(F.get(down, y), j)),
    ))


def squash_and_skew(grid: Column, height: int, width: int) -> Column:
    """The affine transform with linear blending and a black surround."""

    def clamp(v: Column, top: int) -> Column:
        return F.least(F.greatest(v, F.lit(0)), F.lit(top - 1))

    def cell(g: Column, y: Column, x: Column) -> Column:
        sy, sx = skew_point(y.cast("double"), x.cast("double"), height, width)
        inside = (sx >= 0) & (sx < width) & (sy >= 0) & (sy < height)
        fx, fy = F.floor(sx - 0.5), F.floor(sy - 0.5)
        dx, dy = sx - 0.5 - fx, sy - 0.5 - fy

        def blend_row(row: Column) -> Column:
            a = _at(g, row, clamp(fx, width), width).cast("double")
            b = _at(g, row, clamp(fx + 1, width), width).cast("double")
            return a + (b - a) * dx

        upper = blend_row(clamp(fy, height))
        below = F.when((fy + 1 >= 0) & (fy + 1 < height), blend_row(clamp(fy + 1, height))).otherwise(upper)
        return F.when(inside, upper + (below - upper) * dy).otherwise(0.0)

    return let(grid, lambda g: _cells(height, width, lambda y, x: cell(g, y, x)))


def to_chw(grid: Column, height: int, width: int, channels: int) -> Column:
    """Channel-last cells reordered to channel-first."""
    plane = height * width
    return let(grid, lambda g: F.transform(
        F.sequence(F.lit(0), F.lit(plane * channels - 1)),
        lambda k: F.get(g, (F.pmod(k, F.lit(plane)) * channels + div(k, plane)).cast("int")),
    ))


def to_bytes(grid: Column, low: float, high: float) -> Column:
    """Grey levels 0 to 255 for values in [low, high]."""
    def level(v: Column) -> Column:
        return F.floor((v.cast("double") - low) / (high - low) * 255).cast("int")

    return F.transform(grid, lambda v: F.least(F.lit(255), F.greatest(F.lit(0), level(v))))


def rescale(grid: Column) -> Column:
    """Grey levels to [0, 1]."""
    return F.transform(grid, lambda v: v.cast("double") / 255.0)


def normalise(grid: Column, mean: float = 0.5, std: float = 0.5) -> Column:
    return F.transform(grid, lambda v: (v.cast("double") - mean) / std)
