"""Blocks of image vectors, shared by the two searches of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPREAD_SEED = "block"


def usable(vector: Column) -> Column:
    """Not null, not empty, every component a finite number."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def image_vectors(images: DataFrame, key: str, vector: str) -> DataFrame:
    """(id bigint, v array<double>): one row per id that is not null, of its usable vectors the least."""
    rows = images.select(images[key].cast("bigint").alias("id"), images[vector].alias("raw")).filter(F.col("id").isNotNull() & usable(F.col("raw")))
    return rows.groupBy("id").agg(F.min("raw").alias("raw")).select("id", F.col("raw").cast("array<double>").alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; all must have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, 0))
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError("vectors of different length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), int(sizes[0]))


def block_of(key: str, blocks: Column | int) -> Column:
    return F.pmod(F.xxhash64(F.lit(SPREAD_SEED), F.col(key)), blocks if isinstance(blocks, Column) else F.lit(blocks)).cast("int")


def leading(best: DataFrame, n: int, query: str = "query_id", found: str = "id") -> DataFrame:
    """(query, rank, found, score): the ``n`` rows of highest score of every query, ties to smaller ids."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), found))
    return best.withColumn("rank", place).filter(F.col("rank") <= n).select(query, "rank", found, "score")


def top_rows(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, ties to smaller ids."""
    if len(scores) > 4 * n:
        floor = np.partition(scores, len(scores) - n)[len(scores) - n]
        near = np.flatnonzero(scores >= floor)
        return near[np.lexsort((ids[near], -scores[near]))[:n]]
    return np.lexsort((ids, -scores))[:n]

