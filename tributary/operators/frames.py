"""Frames of any size to shot fingerprints: resize, perceptual hash, mean colour, histogram.

A frame is a row of packed pixels.  Resizing is separable, so it is two matrix
products with the windowed-sinc weights of each axis, in whole numbers as 8-bit
images are resized; the frequencies are two more.  Frames stream through an
Arrow map one by one; only features leave it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary import config
from tributary.operators.media import _basis

SIDE = 32
#: Lobes of the windowed sinc, and bits of its weights' whole-number form.
LOBES, BITS = 3, 22
#: Weights of red, green and blue in the luminance, of 65536.
LUMA = (19595, 38470, 7471)


@lru_cache(maxsize=256)
def weights(size: int, out: int) -> np.ndarray:
    """(out, size) whole-number weights of each output sample; each row adds up to about one."""
    scale = size / out
    wide = max(scale, 1.0)
    table = np.zeros((out, size))
    for i in range(out):
        centre = (i + 0.5) * scale
        first, last = max(0, int(centre - LOBES * wide + 0.5)), min(size, int(centre + LOBES * wide + 0.5))
        at = (np.arange(first, last) - centre + 0.5) / wide
        lobe = np.where(np.abs(at) < LOBES, np.sinc(at) * np.sinc(at / LOBES), 0.0)
        table[i, first:last] = lobe / lobe.sum()
    return np.where(table < 0, np.ceil(table * (1 << BITS) - 0.5), np.floor(table * (1 << BITS) + 0.5)).astype(np.int64)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """An 8-bit image (height, width, channels), across and then down, rounded and clipped after each; an axis of the right size stays."""

    def along(values: np.ndarray, out: int) -> np.ndarray:
        if values.shape[1] == out:
            return values
        total = np.einsum("oi,ric->roc", weights(values.shape[1], out), values.astype(np.int64)) + (1 << (BITS - 1))
        return np.clip(total >> BITS, 0, 255).astype(np.uint8)

    across = along(image, width)
    return along(across.transpose(1, 0, 2), height).transpose(1, 0, 2)


def luminance(image: np.ndarray) -> np.ndarray:
    return ((image.astype(np.int64) @ np.array(LUMA) + (1 << 15)) >> 16).astype(np.uint8)[..., None]


def features(image: np.ndarray) -> tuple[str, list[float], list[float]]:
    """Perceptual hash, mean colour in [0, 1] and twelve histogram shares of one frame."""
    gray = resized(luminance(image), SIDE, SIDE)[..., 0].astype(float)
    basis = _basis(SIDE)
    low = (basis @ gray @ basis.T)[:8, :8].copy()
    low[0, 0] = 0.0
    bits = (low > np.median(low)).ravel()[:55]
    prefix = "".join(format(int(x) >> 5, "03b") for x in resized(image, 1, 1)[0, 0])
    small = resized(image, SIDE, SIDE)
    shares = [float(np.count_nonzero(small[..., c] >> 6 == b)) / (3 * SIDE * SIDE) for c in range(3) for b in range(4)]
    return f"{int(prefix + ''.join('1' if b else '0' for b in bits), 2):016x}", [float(x) for x in (small / 255.0).mean(axis=(0, 1))], shares


def frame_features(frames: DataFrame) -> DataFrame:
    """(frame, hash, rgb, hist) of frames (frame, width, height, pixels).

    ``pixels`` holds red, green and blue bytes row by row.  A frame that can't be
    read (nulls, no area, another number of bytes) has the zero hash and no colours.
    """
    names = ["frame", "hash", "rgb", "hist"]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):  # a frame at a time bounds what a task holds
                width, height = batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
                raw = batch.column(3)[row].as_buffer() if batch.column(3)[row].is_valid else b""
                if width and height and min(width, height) > 0 and len(raw) == 3 * width * height:
                    found = features(np.frombuffer(raw, np.uint8).reshape(height, width, 3))
                else:
                    found = (config.ZERO_HASH, None, None)
                columns = [batch.column(0).slice(row, 1), pa.array([found[0]]), *[pa.array([x], pa.list_(pa.float64())) for x in found[1:]]]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = frames.select(F.col("frame").cast("long").alias("frame"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("pixels").cast("binary").alias("pixels"))
    return rows.mapInArrow(run, "frame long, hash string, rgb array<double>, hist array<double>")


def with_features(shots: DataFrame, found: DataFrame) -> DataFrame:
    """Shots of the chain (keyframe, ...) with their keyframe's hash, rgb and hist; the zero hash where a shot has none."""
    rows = shots.join(found.select(F.col("frame").alias("keyframe"), "hash", "rgb", "hist"), "keyframe", "left")
    return rows.withColumn("hash", F.coalesce("hash", F.lit(config.ZERO_HASH)))
