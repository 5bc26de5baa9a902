"""Joins between label tables, stored objects and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell import constants as K


def extension_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def resolve_files(samples: DataFrame, files: DataFrame, sample_id: str = "image_id", file_name: str = "file_name",
                  extensions: Sequence[str] = K.EXTENSIONS) -> DataFrame:
    """Left join of ids to files: the exact name when it has a known extension, else the id plus each
    extension in order of preference, else any file ``<id>.*`` of a known extension.

    Files are reduced to the best one per stem first, so that a stem with many files meets its ids
    as one row. Adds ``file_name`` and ``how`` (exact, preferred, other or NULL).
    """
    order = F.array(*[F.lit(e) for e in extensions])
    listed = files.select(
        F.col(file_name).alias("_file"), base_name(F.col(file_name)).alias("_name"),
        F.regexp_extract(base_name(F.col(file_name)), r"(\.[^.]*)$", 1).alias("_ext"),
    ).filter(F.lower("_ext").isin(*extensions))
    listed = listed.withColumn("_stem", F.expr("substring(_name, 1, length(_name) - length(_ext))"))
    lowered = F.lower("_ext")
    # Extensions written as listed come before the same in other cases.
    preference = F.struct(
        F.when(lowered == F.col("_ext"), F.array_position(order, lowered)).otherwise(len(extensions) + 1).alias("rank"),
        F.col("_file").alias("file"))
    entry = F.struct(F.col("_stem").alias("key"), F.lit(False).alias("exact")), F.struct(F.col("_name").alias("key"), F.lit(True).alias("exact"))
    keyed = listed.withColumn("_best", preference).select("_best", F.inline(F.array(*entry)))
    lookup = keyed.groupBy(F.col("key").alias("_key")).agg(
        F.min(F.when(F.col("exact"), F.col("_best"))).alias("_named"), F.min(F.when(~F.col("exact"), F.col("_best"))).alias("_stemmed"))
    wanted = base_name(F.trim(F.col(sample_id)))
    found = samples.withColumn("_key", wanted).join(lookup, "_key", "left")
    named = extension_of(wanted).isin(*extensions) & F.col("_named").isNotNull()
    how = (F.when(named, "exact").when(F.col("_stemmed").isNull(), None)
           .when(F.col("_stemmed.rank") <= len(extensions), "preferred").otherwise("other"))
    chosen = F.when(named, F.col("_named.file")).otherwise(F.col("_stemmed.file"))
    return found.select(*samples.columns, chosen.alias("file_name"), how.alias("how"))


def missing_report(resolved: DataFrame, sample_id: str = "image_id", preview: int = 20) -> DataFrame:
    """Ids without a file: their number and the first ``preview`` of them."""
    missing = resolved.filter("file_name is null").select(sample_id)
    first = missing.orderBy(sample_id).limit(preview)
    counted = missing.agg(F.count(F.lit(1)).alias("n_missing"))
    shown = first.agg(F.array_join(F.sort_array(F.collect_list(sample_id)), ",").alias("preview"))
    return counted.crossJoin(F.broadcast(shown))


def exclude_known(candidates: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(new candidates, candidates already in the table). Known keys are reduced to one row each."""
    keys = known.select(key).distinct()
    return candidates.join(keys, key, "left_anti"), candidates.join(keys, key, "left_semi")


def merge_one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", check: bool = True) -> DataFrame:
    """Join on key (and label) where each key occurs once per side and no row of either side is lost."""
    on = list(on)
    merged = left.join(right, on, how)
    if not check:
        return merged
    for name, side in (("left", left), ("right", right)):
        repeated = side.groupBy(*on).count().filter("count > 1").limit(1).count()
        if repeated:
            raise ValueError(f"the {name} table repeats keys {on}")
    sizes = (left.count(), right.count(), merged.count())
    if len(set(sizes)) != 1:
        raise ValueError(f"rows were lost in the merge: left {sizes[0]}, right {sizes[1]}, merged {sizes[2]}")
    return merged


def merge_report(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys on both sides, on one side only, and repeated keys, from one aggregation over both tables."""
    sides = left.select(*on, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*on, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    keys = sides.groupBy(*on).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    return keys.agg(
        F.count_if(F.expr("l > 0 and r > 0")).alias("n_both"), F.count_if(F.expr("r = 0")).alias("n_left_only"),
        F.count_if(F.expr("l = 0")).alias("n_right_only"), F.count_if(F.expr("l > 1 or r > 1")).alias("n_repeated"))


def align_optional(left: DataFrame, right: DataFrame, on: str, columns: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Left join of optional features; rows without them get ``fill``."""
    joined = left.join(right.select(on, *columns), on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(fill)) for c in columns})


def rows_for_manifest(features: DataFrame, manifest: DataFrame, row_key: str) -> DataFrame:
    """Feature rows of a split manifest, by an explicit row key."""
    return manifest.join(features, row_key)
