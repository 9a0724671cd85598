"""Model inputs: one preprocessing for training, batch scoring and streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescore.functions.indexmaps import MODEL_SIZE
from framescore.operators.pixels import bgr, has_pixels, resized

# The channel mean and deviation a model input is normalised with.
MEAN, STD = 0.5, 0.5


def tensor_stack(stack: np.ndarray, size: int = MODEL_SIZE, normalise: bool = True) -> np.ndarray:
    """``[n, h, w, c]`` bytes in BGR order to ``[n, 3, size, size]`` floats in RGB order."""
    rgb = resized(bgr(stack), size, size, "cubic")[..., ::-1].astype(np.float32) / np.float32(255)
    if normalise:
        rgb = (rgb - np.float32(MEAN)) / np.float32(STD)
    return np.ascontiguousarray(rgb.transpose(0, 3, 1, 2))


def stacks_of(images: pd.DataFrame) -> Iterator[tuple[pd.Index, np.ndarray]]:
    """The valid images of a batch by size, with their positions."""
    images = images.reset_index(drop=True)
    present = images[has_pixels(images)]
    for (h, w, c), rows in present.groupby(["height", "width", "nChannels"], sort=False):
        pixels = np.frombuffer(b"".join(rows["data"]), np.uint8)
        yield rows.index, pixels.reshape(len(rows), int(h), int(w), int(c))


def to_tensor(image: Column, size: int = MODEL_SIZE, normalise: bool = True) -> Column:
    """An image as a flat ``array<float>``, channels first."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def prepare(images: pd.DataFrame) -> pd.Series:
        out = pd.Series([None] * len(images), dtype=object)
        for index, stack in stacks_of(images):
            flat = tensor_stack(stack, size, normalise).reshape(len(index), -1)
            out.loc[index] = pd.Series(list(flat), index=index, dtype=object)
        return out

    return prepare(image)


def pooled(stack: np.ndarray, size: int) -> np.ndarray:
    """``[n, 3 * size * size]``: mean, least and greatest grey level of each block, in [0, 1]."""
    h, w = (max(n, size) for n in stack.shape[1:3])
    grey = resized(bgr(stack), h, w, "nearest").mean(axis=3, dtype=np.float32)
    rows, cols = (np.arange(size) * n // size for n in (h, w))

    def reduce(ufunc: np.ufunc) -> np.ndarray:
        return ufunc.reduceat(ufunc.reduceat(grey, rows, axis=1), cols, axis=2)

    area = np.diff(np.append(rows, h))[:, None] * np.diff(np.append(cols, w))
    blocks = np.stack([reduce(np.add) / area, reduce(np.minimum), reduce(np.maximum)], axis=1)
    return (blocks / 255).reshape(len(stack), -1).astype(np.float32)


def pixel_features(image: Column, size: int = 8) -> Column:
    """Features without a network, as ``array<float>``: what each block of an image spans."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def pool(images: pd.DataFrame) -> pd.Series:
        out = pd.Series([None] * len(images), dtype=object)
        for index, stack in stacks_of(images):
            out.loc[index] = pd.Series(list(pooled(stack, size)), index=index, dtype=object)
        return out

    return pool(image)

