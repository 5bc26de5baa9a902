"""Shaping of metric documents and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.functions.numeric import clip

CLASS_DOCUMENT = "per_class map<string, struct<precision: double, recall: double, f1: double, support: bigint>>"


def flatten_models(df: DataFrame, document: str, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per model from nested metric documents: the named scalars and the recall per class."""
    schema = ", ".join([*[f"{m} double" for m in metrics], CLASS_DOCUMENT])
    parsed = df.select(*by, F.from_json(document, schema).alias("d"))
    return parsed.select(
        *by, *[F.col(f"d.{m}") for m in metrics],
        *[F.try_element_at("d.per_class", F.lit(str(k)))["recall"].alias(f"class_{k}_recall") for k in K.GRADES])


def flatten_classes(df: DataFrame, document: str, by: Sequence[str]) -> DataFrame:
    """One row per model and class."""
    parsed = df.select(*by, F.from_json(document, CLASS_DOCUMENT).alias("d"))
    entries = parsed.select(*by, F.explode("d.per_class").alias("label", "m"))
    return entries.select(*by, F.col("label").cast("int").alias("label"), "m.recall", "m.support")


def export_predictions(df: DataFrame, ordinal: str, min_grade: int = K.POSITIVE_MIN_GRADE) -> DataFrame:
    """Predictions with the derived binary columns: score / 4 clipped to [0, 1] and both binary labels."""
    return df.withColumns({
        "binary_score": clip(F.col(ordinal) / 4.0, 0.0, 1.0),
        "true_positive_grade": (F.col("y_true") >= min_grade).cast("int"),
        "pred_positive_grade": (F.col("y_pred") >= min_grade).cast("int"),
    })
