"""Where each output pixel of a geometric operator is read from.

The maps use only ``+ - *``, so one definition serves Catalyst columns (small
grids) and NumPy index arrays (whole images). Each takes the output position and
the source size ``h, w`` and returns the source position.
"""

from __future__ import annotations

import numpy as np

# The transforms an augmentation draws from, the affine matrix
# (its offsets are fractions of the width and height) and the crop bias.
TRANSFORMS = ["horizontal", "vertical", "rotate_90", "rotate_180", "rotate_270", "squash&skew"]
SKEW = (1.0, 0.3, -0.15, 0.3, 1.0, -0.15)
CROP_BIAS = 0.40
STORED_SIZE = 256
MODEL_SIZE = 224

SOURCE_OF = {
    "horizontal": lambda y, x, h, w: (y, w - 1 - x),
    "vertical": lambda y, x, h, w: (h - 1 - y, x),
    "rotate_90": lambda y, x, h, w: (x, w - 1 - y),
    "rotate_180": lambda y, x, h, w: (h - 1 - y, w - 1 - x),
    "rotate_270": lambda y, x, h, w: (h - 1 - x, y),
}

SWAPS_SIDES = {"rotate_90", "rotate_270"}


def skew_point(y, x, size_h, size_w):
    """The point in the source that the centre of output pixel (y, x) falls on."""
    a, b, c, d, e, f = SKEW
    px, py = x + 0.5, y + 0.5
    return px * d + py * e + size_h * f, px * a + py * b + size_w * c


def _triangle(t: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 - np.abs(t))


def _cubic(t: np.ndarray, a: float = -0.5) -> np.ndarray:
    u = np.abs(t)
    near = (a + 2) * u**3 - (a + 3) * u**2 + 1
    far = a * u**3 - 5 * a * u**2 + 8 * a * u - 4 * a
    return np.where(u < 1, near, np.where(u < 2, far, 0.0))


FILTERS = {"bilinear": _triangle, "cubic": _cubic}


def resize_weights(n_in: int, n_out: int, filter_name: str) -> np.ndarray:
    """``[n_out, n_in]`` shares of each input cell; the filter widens when shrinking."""
    step = n_in / n_out
    spread = max(1.0, step)
    distance = (np.arange(n_in) + 0.5)[None, :] - ((np.arange(n_out) + 0.5) * step)[:, None]
    raw = FILTERS[filter_name](distance / spread)
    return raw / raw.sum(axis=1, keepdims=True)
