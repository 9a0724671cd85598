"""Synthetic images, as arrays in RGB order and as files."""

from __future__ import annotations

from pathlib import Path

import numpy as np

from framescore.operators.pixels import _png
from framescore.schema import IMAGE


def ramp(h: int = 6, w: int = 9, c: int = 3) -> np.ndarray:
    return (np.arange(h * w * c) % 256).astype(np.uint8).reshape(h, w, c)


def noise(h: int, w: int, c: int = 3, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)


def bgr_bytes(rgb: np.ndarray) -> bytes:
    return rgb[..., [2, 1, 0, 3][: rgb.shape[2]]].tobytes() if rgb.shape[2] > 1 else rgb.tobytes()


def write_png(path: Path, rgb: np.ndarray) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(_png(*rgb.shape, bgr_bytes(rgb)))


def struct(rgb: np.ndarray) -> tuple:
    h, w, c = rgb.shape
    return ("", h, w, c, {1: 0, 3: 16, 4: 24}[c], bytearray(bgr_bytes(rgb)))


def table(spark, images: dict[str, np.ndarray]):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("image", IMAGE)])
    return spark.createDataFrame([(n, struct(a)) for n, a in images.items()], schema)


def arrays(df) -> dict[str, np.ndarray]:
    """Images by name, back in RGB order."""
    out = {}
    for row in df.select("name", "image").collect():
        i = row.image
        pixels = np.frombuffer(bytes(i.data), np.uint8).reshape(i.height, i.width, i.nChannels)
        out[row.name] = pixels[..., [2, 1, 0, 3][: i.nChannels]] if i.nChannels > 1 else pixels
    return out
