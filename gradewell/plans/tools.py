"""Small helpers of the plan modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that float sums in another order compare equal."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def doubles_sql(values) -> str:
    return "[" + ", ".join(f"{v!r}::double" for v in values) + "]"
