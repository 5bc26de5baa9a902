"""Inventory of the tables of a dataset."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inventory(tables: Mapping[str, DataFrame], label: str, content: str) -> DataFrame:
    """Per table: rows, columns, label counts as JSON, whether it has labels and content hashes."""
    out = None
    for name, df in tables.items():
        has_label = label in df.columns
        key = F.col(label).cast("string") if has_label else F.lit(None).cast("string")
        per_label = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("v"))
        pairs = F.sort_array(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))
        row = per_label.agg(
            F.lit(name).alias("table_name"), F.coalesce(F.sum("v"), F.lit(0)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
            F.to_json(F.map_from_entries(pairs)).alias("label_counts"),
            F.lit(has_label).alias("has_label"), F.lit(content in df.columns).alias("has_hash"))
        out = row if out is None else out.unionByName(row)
    return out
