"""Image preparation: pixel-array expressions, and the same steps on packed bytes for a batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# fixed values: ImageNet channel means and deviations of the network's input scaling
MEANS = (0.485, 0.456, 0.406)
DEVIATIONS = (0.229, 0.224, 0.225)


def invert_image(px: Column) -> Column:
    return F.transform(px, lambda p: 255 - p)


def replicate_channels(px: Column, channels: int = 3) -> Column:
    """Grey pixels to interleaved equal channels."""
    return F.flatten(F.transform(px, lambda p: F.array_repeat(p, channels)))


def resize_nearest(px: Column, src: tuple[int, int], dst: tuple[int, int]) -> Column:
    """Nearest neighbour at pixel centres, row-major single-channel pixels."""
    (sh, sw), (dh, dw) = src, dst

    def source(p: Column) -> Column:
        r = F.floor((F.floor(p / dw) + 0.5) * sh / dh)
        c = F.floor((p % dw + 0.5) * sw / dw)
        return F.get(px, (r * sw + c).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(dh * dw - 1)), source)


def normalize_channels(px: Column) -> Column:
    """Interleaved 0..255 channels to zero-mean, unit-deviation network input."""
    means = F.array(*[F.lit(v) for v in MEANS])
    devs = F.array(*[F.lit(v) for v in DEVIATIONS])
    return F.transform(px, lambda p, i: (p / 255.0 - F.get(means, i % 3)) / F.get(devs, i % 3))


def tensors(data: list[bytes], heights: np.ndarray, widths: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Packed grey bytes to the float32 network input of shape (n, h, w, 3); images of one size are handled together."""
    out = np.empty((len(data), *size, len(MEANS)), np.float32)
    shapes = np.stack([heights, widths], axis=1)
    for height, width in np.unique(shapes, axis=0):
        own = np.flatnonzero((heights == height) & (widths == width))
        grey = 255 - np.frombuffer(b"".join([data[i] for i in own]), dtype=np.uint8).reshape(len(own), height, width).astype(np.float32)
        rows = ((np.arange(size[0]) + 0.5) * height / size[0]).astype(np.int64)
        cols = ((np.arange(size[1]) + 0.5) * width / size[1]).astype(np.int64)
        picked = grey[:, rows][:, :, cols, None] / np.float32(255.0)
        out[own] = (picked - np.float32(MEANS)) / np.float32(DEVIATIONS)
    return out


def tensor(data: bytes, height: int, width: int, size: tuple[int, int]) -> np.ndarray:
    """The network input of one image."""
    return tensors([data], np.array([height]), np.array([width]), size)[0]
