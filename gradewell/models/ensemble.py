"""Ensembles over prediction tables in long form (one row per item and model)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.functions.probability import weighted_vote


def side_by_side(predictions: DataFrame, models: Sequence[str], key: str = "row_id", prob: str = "prob") -> DataFrame:
    """One row per item with a probability array per model, by one aggregation on the item."""
    arrays = [F.max(F.when(F.col("model") == m, F.col(prob))).alias(f"prob_{i}") for i, m in enumerate(models)]
    wide = predictions.filter(F.col("model").isin(*models)).groupBy(key).agg(*arrays)
    return wide.na.drop(subset=[f"prob_{i}" for i in range(len(models))])


def vote(predictions: DataFrame, models: Sequence[str], weights: Sequence[float] | None = None, key: str = "row_id") -> DataFrame:
    """Soft voting: (weighted) mean probabilities of the items every model has scored."""
    wide = side_by_side(predictions, models, key)
    return wide.select(key, weighted_vote([F.col(f"prob_{i}") for i in range(len(models))], weights).alias("prob"))
