"""Row-level cleaning on the way in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.functions.labels import integer_label, text_label
from gradewell.functions.numeric import finite, param_value


def sanitize(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """NaN and infinities become NULL; rows without any feature value are dropped."""
    clean = df.withColumns({f: finite(F.col(f).cast("double")) for f in features})
    return clean.na.drop("all", subset=list(features))


def sanitize_report(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing and infinite cells before, rows removed, missing cells after, largest magnitude: one pass."""
    cells = [F.col(f).cast("double") for f in features]

    def tally(condition) -> Column:
        total = F.lit(0)
        for c in cells:
            total = total + F.coalesce(condition(c), F.lit(False)).cast("int")
        return total

    missing = tally(lambda c: finite(c).isNull())
    removed = missing == len(features)
    return df.agg(
        F.sum(tally(lambda c: c.isNull() | F.isnan(c))).alias("nan_cells_before"),
        F.sum(tally(lambda c: F.abs(c) == float("inf"))).alias("inf_cells_before"),
        F.count_if(removed).alias("rows_removed"),
        F.sum(F.when(removed, 0).otherwise(missing)).alias("missing_cells_after"),
        F.max(F.greatest(*[F.abs(finite(c)) for c in cells])).alias("max_abs_after"),
    )


def valid_labels(df: DataFrame, raw: str, labels: Sequence[int] = K.GRADES) -> DataFrame:
    """Add ``label`` and ``label_ok`` for integer labels."""
    return df.withColumn("label", integer_label(F.col(raw), labels)).withColumn("label_ok", F.col("label").isNotNull())


def text_labels(df: DataFrame, raw: str) -> DataFrame:
    """Add ``label`` and ``label_ok`` for names, synonyms or numbers."""
    return df.withColumn("label", text_label(F.col(raw))).withColumn("label_ok", F.col("label").isNotNull())


def pack_params(df: DataFrame, columns: Sequence[str], prefix: str = "params_",
                integers: Sequence[str] = K.INTEGER_PARAMS) -> DataFrame:
    """Gather ``params_*`` columns into one map: prefix cut off, whole numbers for the integer ones, NaN as NULL."""
    entries = []
    for column in columns:
        name = column.removeprefix(prefix)
        entries += [F.lit(name), param_value(F.col(column).cast("string"), F.lit(name), integers)]
    return df.withColumn("params", F.create_map(*entries)).drop(*columns)


def parse_params(df: DataFrame, document: str, integers: Sequence[str] = K.INTEGER_PARAMS) -> DataFrame:
    """A JSON object of parameters as a map of text values, typed as in :func:`pack_params`."""
    parsed = F.from_json(document, "map<string,string>")
    typed = F.transform_values(parsed, lambda name, value: param_value(value, name, integers))
    return df.withColumn("params", typed)


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share in percent, 0 for an empty whole."""
    return F.round(F.when(whole > 0, part * 100.0 / whole).otherwise(0.0), digits)
