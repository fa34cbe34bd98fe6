"""Kernels over frames, a whole Arrow batch at a time: frames are flat arrays of numbers of one width.

Frames of one size are stacked, so a batch is a few matrix products and shifts; there is no loop over rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FEATURES = "mean double, deviation double, difference_hash long, edges double"


def _stacked(frames: pd.Series, width: int, kernel: Callable[[np.ndarray], np.ndarray], out: np.ndarray, *others: pd.Series) -> np.ndarray:
    """``out`` with the kernel's results for all frames of each size; cells beyond whole lines are left out."""
    sizes = np.array([0 if x is None or any(y is None or len(y) != len(x) for y in more) else len(x) // width * width for x, *more in zip(frames, *others, strict=True)], np.int64)
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        images = [np.stack([np.asarray(column.iloc[k], np.float64)[:size] for k in at]).reshape(len(at), -1, width) for column in (frames, *others)]
        out[at] = kernel(*images)
    return out


@lru_cache(maxsize=16)
def cosines(n: int, first: int) -> np.ndarray:
    """The first rows of the discrete cosine transform of ``n`` values (type II, unscaled)."""
    return 2 * np.cos(np.pi * np.outer(np.arange(first), 2 * np.arange(n) + 1) / (2 * n))


def perceptual_bits(images: np.ndarray, size: int) -> np.ndarray:
    """Whether each of the ``size`` by ``size`` lowest frequencies is above their median: one row of bits a frame."""
    low = cosines(images.shape[1], min(size, images.shape[1])) @ images @ cosines(images.shape[2], min(size, images.shape[2])).T
    low = low.reshape(len(images), -1)
    return low > np.median(low, axis=1, keepdims=True)


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as signed longs, the first bit the highest; a last word that isn't full is filled with 0."""
    whole = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    whole[:, : bits.shape[1]] = bits
    return np.packbits(whole, axis=1).view(">i8").astype(np.int64)


def perceptual_hash(frame: Column, width: int, size: int) -> Column:
    """The bits of :func:`perceptual_bits` as ``array<long>``; null for frames that are null or shorter than a line."""

    def hashed(frames: pd.Series) -> pd.Series:
        rows = np.empty(len(frames), object)

        def kernel(images: np.ndarray) -> np.ndarray:
            made = np.empty(len(images), object)
            made[:] = list(words(perceptual_bits(images, size)))
            return made

        return pd.Series(_stacked(frames, width, kernel, rows), dtype=object)

    return F.pandas_udf(hashed, "array<long>")(frame)


def dilated(mask: np.ndarray, reach: int) -> np.ndarray:
    """Masks grown by ``reach`` cells to all sides: lines first, then columns, each by shifts."""
    for axis in (1, 2):
        grown = mask.copy()
        for step in range(1, reach + 1):
            near, far = [slice(None)] * 3, [slice(None)] * 3
            near[axis], far[axis] = slice(None, -step or None), slice(step, None)
            grown[tuple(near)] |= mask[tuple(far)]
            grown[tuple(far)] |= mask[tuple(near)]
        mask = grown
    return mask


def edges(images: np.ndarray, step: float) -> np.ndarray:
    """Cells that differ by more than ``step`` from the next one to the right or below, grown by one cell."""
    mask = np.zeros(images.shape, bool)
    mask[:, :, :-1] |= np.abs(np.diff(images, axis=2)) > step
    mask[:, :-1] |= np.abs(np.diff(images, axis=1)) > step
    return dilated(mask, 1)


def kept_edges(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The share of the first masks' cells that are within two cells of one of the second's; 0 without any."""
    total = one.sum(axis=(1, 2))
    return (one & dilated(two, 2)).sum(axis=(1, 2)) / np.maximum(total, 1)


def edge_overlap(a: Column, b: Column, width: int, step: float) -> Column:
    """The smaller of the shares of edges that each of two frames keeps of the other's; 0 if one has none.

    Null for frames that are null, shorter than a line, or of different sizes.
    """

    def kernel(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        x, y = edges(one, step), edges(two, step)
        return np.minimum(kept_edges(x, y), kept_edges(y, x))

    return F.pandas_udf(lambda one, two: pd.Series(_stacked(one, width, kernel, np.full(len(one), np.nan), two)).astype("Float64"), "double")(a, b)


def features(frame: Column, width: int) -> Column:
    """Mean, deviation, difference hash (63 bits at most) and share of steps over 1 of each frame; zeros for none."""

    def kernel(images: np.ndarray) -> np.ndarray:
        steps = np.abs(np.diff(images, axis=2)).reshape(len(images), -1)
        right = (images[:, :, 1:] > images[:, :, :-1]).reshape(len(images), -1)[:, :63]
        places = 1 << np.arange(right.shape[1], dtype=np.int64)[::-1]
        made = np.empty((len(images), 4), object)
        made[:, 0], made[:, 1] = images.mean(axis=(1, 2)), images.std(axis=(1, 2))
        made[:, 2] = right.astype(np.int64) @ places if right.shape[1] else 0
        made[:, 3] = (steps > 1).mean(axis=1) if steps.shape[1] else 0.0
        return made

    def told(frames: pd.Series) -> pd.DataFrame:
        out = np.empty((len(frames), 4), object)
        out[:] = [0.0, 0.0, 0, 0.0]
        return pd.DataFrame(_stacked(frames, width, kernel, out), columns=["mean", "deviation", "difference_hash", "edges"]).astype({"mean": float, "deviation": float, "difference_hash": "int64", "edges": float})

    return F.pandas_udf(told, FEATURES)(frame)


def pair_metrics(a: Column, b: Column, bins: int = 16) -> Column:
    """Mean squared error, share of values that differ by more than 1, and histogram correlation of two frames.

    Null for frames that are null, empty or of different sizes.
    """

    def counted(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        place = np.minimum((values - lo) / (hi - lo) * bins, bins - 1).astype(np.int64)
        return np.stack([(place == k).sum(axis=1) for k in range(bins)], axis=1).astype(np.float64)

    def kernel(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        x, y = one.reshape(len(one), -1), two.reshape(len(two), -1)
        lo, hi = np.minimum(x.min(axis=1), y.min(axis=1))[:, None], np.maximum(x.max(axis=1), y.max(axis=1))[:, None] + 1e-9
        hx, hy = counted(x, lo, hi), counted(y, lo, hi)
        dx, dy = hx - hx.mean(axis=1, keepdims=True), hy - hy.mean(axis=1, keepdims=True)
        norm = np.sqrt((dx**2).sum(axis=1) * (dy**2).sum(axis=1))
        like = np.where(norm > 0, (dx * dy).sum(axis=1) / np.where(norm > 0, norm, 1), 1.0)
        return np.stack([((x - y) ** 2).mean(axis=1), (np.abs(x - y) > 1).mean(axis=1), like], axis=1)

    def metrics(one: pd.Series, two: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_stacked(one, 1, kernel, np.full((len(one), 3), np.nan), two), columns=["mse", "changed", "histogram"]).astype("Float64")

    return F.pandas_udf(metrics, "mse double, changed double, histogram double")(a, b)
