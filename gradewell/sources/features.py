"""Feature tables with a fixed list of column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from gradewell import constants as K
from gradewell.functions.numeric import to_double


def feature_columns(df: DataFrame, names: Sequence[str], label: str = "label") -> list[str]:
    """The wanted names when all are there, else the legacy six; otherwise an error naming up to ten missing."""
    if label not in df.columns:
        raise ValueError(f"the table has no {label} column")
    missing = [n for n in names if n not in df.columns]
    if not missing:
        return list(names)
    if all(n in df.columns for n in K.LEGACY_FEATURES):
        return list(K.LEGACY_FEATURES)
    raise ValueError(f"{len(missing)} feature columns are missing: {missing[:10]}")


def numeric_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Fallback without a name list: every numeric column in table order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def scan_features(df: DataFrame, names: Sequence[str], label: str = "label", keep: Sequence[str] = ()) -> DataFrame:
    """Metadata, label and the features as doubles; only those columns reach the file scan."""
    chosen = feature_columns(df, names, label)
    return df.select(*keep, F.col(label).cast("int").alias(label), *[to_double(F.col(n).cast("string") if dict(df.dtypes)[n] == "string" else F.col(n)).alias(n) for n in chosen])
