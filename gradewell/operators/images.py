"""One job over decoded images: metrics, difference hash and colour statistics.

Spark reads, decodes and partitions the images; each task works on batches of its own rows with
NumPy. Sizes differ per image, so the loop over a batch is per image and vectorised inside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.functions.quality import simple_flags, simple_status

METRICS = "blur_score double, brightness_mean double, contrast_std double, dhash bigint"
CHANNEL_STATS = ["mean", "std", "min", "max", "entropy", "skewness", "kurtosis"]
CHANNELS = ["blue", "green", "red"]
COLOUR = ", ".join(f"{c}_{s} double" for c in CHANNELS for s in CHANNEL_STATS)
# Grey = weighted sum of blue, green, red (fixed values).
GREY_WEIGHTS = np.array([0.114, 0.587, 0.299])


def grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] == 1:
        return pixels[:, :, 0].astype("float64")
    return np.rint(pixels[:, :, :3].astype("float64") @ GREY_WEIGHTS)


def laplacian_variance(image: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian with mirrored borders (the edge pixel is not repeated)."""
    padded = np.pad(image, 1, mode="reflect") if min(image.shape) > 1 else np.pad(image, 1, mode="edge")
    laplacian = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * image
    return float(laplacian.var())


def area_weights(source: int, target: int) -> np.ndarray:
    """Rows average the source cells covered by each target cell, by covered length."""
    edges = np.linspace(0, source, target + 1)
    cells = np.arange(source)
    overlap = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    weights = np.clip(overlap, 0, None)
    return weights / weights.sum(axis=1, keepdims=True)


def difference_hash(image: np.ndarray, size: int = 8) -> int:
    """64 bits: is a cell of the area-averaged (size x size+1) image brighter than its left neighbour; signed."""
    small = np.rint(area_weights(image.shape[0], size) @ image @ area_weights(image.shape[1], size + 1).T)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def channel_statistics(values: np.ndarray, bins: int = 32) -> list[float]:
    """Mean, deviation, range, histogram entropy in bits, skewness and excess kurtosis (0 when flat)."""
    flat = values.astype("float64").ravel()
    mean, std = flat.mean(), flat.std()
    counts = np.histogram(flat, bins=bins)[0]
    p = counts[counts > 0] / counts.sum()
    z = (flat - mean) / std if std > 1e-8 else None
    return [mean, std, flat.min(), flat.max(), float(-(p * np.log2(p)).sum()),
            float((z ** 3).mean()) if z is not None else 0.0, float((z ** 4).mean() - 3.0) if z is not None else 0.0]


def _kernel(batches: Iterator[pd.DataFrame], colour: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, readable, width, height, channels, data in batch.itertuples(index=False):
            row: list = [path]
            try:
                if not readable:
                    raise ValueError("the image could not be decoded")
                pixels = np.frombuffer(data, dtype="uint8").reshape(height, width, channels)
                image = grey(pixels)
                row += [int(width), int(height), True, None, laplacian_variance(image), float(image.mean()), float(image.std()), difference_hash(image)]
                if colour:
                    for c in range(3):
                        row += channel_statistics(pixels[:, :, min(c, channels - 1)])
            except ValueError as error:
                row = [path, max(int(width or 0), 0), max(int(height or 0), 0), False, str(error), 0.0, 0.0, 0.0, -1] + ([None] * (3 * len(CHANNEL_STATS)) if colour else [])
            rows.append(row)
        names = ["path", "width", "height", "ok", "error", "blur_score", "brightness_mean", "contrast_std", "dhash"]
        if colour:
            names += [f"{c}_{s}" for c in CHANNELS for s in CHANNEL_STATS]
        yield pd.DataFrame(rows, columns=names)


def image_metrics(images: DataFrame, colour: bool = False) -> DataFrame:
    """Metrics per image of :func:`gradewell.sources.objects.scan_pixels`, with ``ok`` and ``error``.

    Unreadable images keep a row with zero metrics and hash -1; that value is also a legal hash, so
    they must be gated before hashes are compared.
    """
    schema = "path string, width int, height int, ok boolean, error string, " + METRICS + (", " + COLOUR if colour else "")
    columns = images.select("path", "readable", "width", "height", "channels", "data")
    return columns.mapInPandas(lambda batches: _kernel(batches, colour), schema)


def quality_table(images: DataFrame) -> DataFrame:
    """Image metrics with size, flags, status and the pass decision of the simple gate; every image is decoded once."""
    table = image_metrics(images).withColumn("readable", F.col("ok"))
    flags = simple_flags(F.col("width"), F.col("height"), F.col("blur_score"), F.col("brightness_mean"), F.col("contrast_std"))
    tiny = ~F.col("readable") | (F.col("width") < 200) | (F.col("height") < 200)
    return table.withColumns({
        "tiny_or_invalid": tiny, "status": simple_status(flags, F.col("readable")),
        "quality_pass": F.col("readable") & (F.size(flags) == 0),
    })
