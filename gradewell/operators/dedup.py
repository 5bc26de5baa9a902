"""Exact duplicates.

``row_number() = 1`` is computed with a group limit in every task before the shuffle, so a group of
copies holding a third of the table sends one row per task, not all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell import constants as K


def keep_first(df: DataFrame, group: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every group in the order of an explicit key."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def vector_digest(features: Sequence[str]) -> Column:
    """256-bit digest of a feature vector: a short shuffle key in place of hundreds of columns.

    -0.0 equals 0.0 and NULL equals NULL, as in a comparison of the columns themselves.
    """
    parts = [F.coalesce((F.col(f) + F.lit(0.0)).cast("double").cast("string"), F.lit("null")) for f in features]
    return F.sha2(F.concat_ws("|", *parts), 256)


def dedup_vectors(df: DataFrame, features: Sequence[str], order: str, label: str | None = "label") -> DataFrame:
    """Keep the first row per feature vector and label, or per vector whatever its label (``label=None``).

    Groups are formed by digest; equal digests of unequal vectors are not known to exist.
    """
    keyed = df.withColumn("_digest", vector_digest(features))
    group = ["_digest", label] if label else ["_digest"]
    return keep_first(keyed, group, [order]).drop("_digest")


def conflicting_vectors(df: DataFrame, features: Sequence[str], label: str = "label", key: str = "row_id") -> DataFrame:
    """Vectors that occur under several labels: first key, rows, number of labels, labels."""
    per_label = df.groupBy(vector_digest(features).alias("_digest"), label).agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    return per_label.groupBy("_digest").agg(
        F.min("first").alias("first_key"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_labels"),
        F.array_join(F.sort_array(F.collect_list(F.col(label).cast("string"))), ",").alias("labels"),
    ).filter("n_labels > 1").drop("_digest")


def duplicate_members(df: DataFrame, features: Sequence[str], salts: int = 16) -> DataFrame:
    """Every row of a vector that occurs more than once, with the size of its group.

    Sizes are counted first (with map-side combine); only repeated digests are joined back. Rows of one digest are
    dealt over ``salts`` tasks, each of which gets a copy of the one row with the size.
    """
    keyed = df.withColumn("_digest", vector_digest(features)).withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    sizes = keyed.groupBy("_digest").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    copied = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return keyed.join(copied, ["_digest", "_salt"]).drop("_digest", "_salt")


def duplicate_report(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Rows in duplicate groups and rows to remove, with and without the label."""
    per_label = df.groupBy(vector_digest(features).alias("_digest"), label).agg(F.count(F.lit(1)).alias("n"))
    vectors = per_label.groupBy("_digest").agg(
        F.sum("n").alias("m"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("exact"),
        F.sum(F.col("n") - 1).alias("extra"))
    return vectors.agg(
        F.coalesce(F.sum(F.when(F.col("m") > 1, F.col("m"))), F.lit(0)).alias("duplicate_feature_rows"),
        F.coalesce(F.sum("exact"), F.lit(0)).alias("exact_duplicate_rows"),
        F.coalesce(F.sum("extra"), F.lit(0)).alias("removed_with_label"),
        F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("removed_any_label"))


def distinct_paths(manifest: DataFrame, path: str = "path", readable: str = "readable") -> DataFrame:
    """Readable manifest rows, the first per normalised path (separators and case folded)."""
    folded = F.lower(F.regexp_replace(F.trim(F.col(path)), r"[\\/]+", "/"))
    return keep_first(manifest.filter(F.col(readable)).withColumn("_path", folded), ["_path"], [path]).drop("_path")


def append_dedup(current: DataFrame, extra: DataFrame, features: Sequence[str], content: str, order: str) -> DataFrame:
    """Current and extra rows, then one per content hash, then one per feature vector; current rows come first."""
    merged = current.withColumn("_new", F.lit(0)).unionByName(extra.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    by_content = keep_first(merged, [content], ["_new", order])
    return keep_first(by_content.withColumn("_digest", vector_digest(features)), ["_digest"], ["_new", order]).drop("_digest", "_new")


def growth_report(current: DataFrame, extra: DataFrame, combined: DataFrame, label: str = "label",
                  labels: Sequence[int] = K.GRADES) -> DataFrame:
    """Per label: rows before, offered and after, increase and new share; and all rows removed."""
    tagged = [t.select(label, F.lit(name).alias("part")) for t, name in ((current, "old"), (extra, "extra"), (combined, "new"))]
    counts = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("part", label).agg(F.count(F.lit(1)).alias("n"))
    parts = ["old", "extra", "new"]
    wide = counts.agg(*[
        F.coalesce(F.sum(F.when((F.col("part") == p) & (F.col(label) == k), F.col("n"))), F.lit(0)).alias(f"{p}_{k}")
        for p in parts for k in labels
    ], *[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(f"{p}_total") for p in parts])
    rows = [F.struct(
        F.lit(k).alias("label"), F.col(f"old_{k}").alias("old_count"), F.col(f"extra_{k}").alias("extra_count"),
        F.col(f"new_{k}").alias("new_count"), (F.col(f"new_{k}") - F.col(f"old_{k}")).alias("increase"),
        F.round(F.col(f"new_{k}") / F.greatest(F.col("new_total"), F.lit(1)) * 100.0, 2).alias("new_pct"),
        (F.col("old_total") + F.col("extra_total") - F.col("new_total")).alias("removed")) for k in labels]
    return wide.select(F.inline(F.array(*rows)))
