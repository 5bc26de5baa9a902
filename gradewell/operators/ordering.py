"""Global orders without a global sort in one task.

A window over a grade, a model or a source would send a third of all rows to one task. Both
orders used here are cut into buckets first: a hash order by the leading hex digits of the hash
(uniform by construction), a value order by ranges of the distinct values. Counts per
bucket give the offset of a bucket; only rows inside one bucket are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.session import settle, store

HASH_DIGITS = 3
WHOLE = "_whole"


def match(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``by`` where NULL meets NULL, as grouping does; the columns of ``by`` come from ``left``."""
    if not by:
        return left.crossJoin(right)
    renamed = right.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    return left.join(renamed, same, how).drop(*[f"_of_{c}" for c in by])


def hash_order(seed: int, *keys: str) -> Column:
    """Engine-independent random order: md5 of the seed and the key columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_ranked(df: DataFrame, strata: Sequence[str], key: str, seed: int, digits: int = HASH_DIGITS) -> DataFrame:
    """Add ``hash_rank``: the exact 1-based position in the hash order within the stratum."""
    hashed = df.withColumn("_hash", hash_order(seed, key)).withColumn("_bucket", F.substring("_hash", 1, digits))
    sizes = hashed.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(sizes.select(*strata, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_hash", key)
    return (
        match(hashed, offsets, [*strata, "_bucket"])
        .withColumn("hash_rank", F.col("_offset") + F.row_number().over(inside))
        .drop("_hash", "_bucket", "_offset")
    )


def _with_strata(df: DataFrame, targets: DataFrame, strata: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Without strata the whole table is one."""
    if strata:
        return df, targets, list(strata)
    return df.withColumn(WHOLE, F.lit(0)), targets.withColumn(WHOLE, F.lit(0)), [WHOLE]


def bucket_sizes(df: DataFrame, strata: Sequence[str], key: str, seed: int, digits: int = HASH_DIGITS) -> DataFrame:
    """Rows per stratum and hash bucket: at most 16 ** digits rows per stratum."""
    bucket = F.substring(hash_order(seed, key), 1, digits)
    return settle(df.groupBy(*strata, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")))


def hash_cuts(df: DataFrame, strata: Sequence[str], key: str, seed: int, targets: DataFrame,
              digits: int = HASH_DIGITS, sizes: DataFrame | None = None) -> DataFrame:
    """The (hash, key) found at given ranks of the hash order, one array of cuts per stratum.

    ``targets`` holds one row per stratum and cut: the strata columns, ``cut`` (0, 1, ...) and
    ``upto``, the last rank that belongs to the block. Only the rows of the bucket in which a rank
    falls are ordered.
    """
    df, targets, strata = _with_strata(df, targets, strata)
    slim = df.select(*strata, key, hash_order(seed, key).alias("_hash"))
    slim = slim.withColumn("_bucket", F.substring("_hash", 1, digits))
    if sizes is None:
        sizes = bucket_sizes(df, strata, key, seed, digits)
    run = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    edges = sizes.select(*strata, "_bucket", "_n", F.sum("_n").over(run).alias("_end"))
    hit = (
        match(edges, targets, strata)
        .filter((F.col("upto") <= F.col("_end")) & (F.col("upto") > F.col("_end") - F.col("_n")))
        .select(*strata, "_bucket", "cut", (F.col("upto") - F.col("_end") + F.col("_n")).alias("_position"))
    )
    hit = settle(hit)
    order = Window.partitionBy(*strata, "cut").orderBy("_hash", key)
    found = (
        match(slim, hit, [*strata, "_bucket"])
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == F.col("_position"))
        .select(*strata, "cut", F.col("_hash").alias("h"), F.col(key).alias("k"))
    )
    # A rank of 0 lies before every row ("" sorts first), a rank beyond the stratum after every row.
    totals = sizes.groupBy(*strata).agg(F.sum("_n").alias("_total"))
    filled = (
        match(match(targets, totals, strata), found, [*strata, "cut"], "left")
        .withColumn("h", F.when(F.col("upto") <= 0, "").when(F.col("upto") > F.col("_total"), "~").otherwise(F.col("h")))
    )
    return settle(
        filled.groupBy(*strata).agg(F.sort_array(F.collect_list(F.struct("cut", "h", "k"))).alias("_cuts"))
    )


def assign_blocks(df: DataFrame, strata: Sequence[str], key: str, seed: int, targets: DataFrame,
                  column: str = "block", digits: int = HASH_DIGITS, sizes: DataFrame | None = None) -> DataFrame:
    """Add the number of the block between cuts a row falls in; the wide rows are never shuffled."""
    df, targets, strata = _with_strata(df, targets, strata)
    return apply_cuts(df, strata, key, seed, hash_cuts(df, strata, key, seed, targets, digits, sizes), column)


def apply_cuts(df: DataFrame, strata: Sequence[str], key: str, seed: int, cuts: DataFrame, column: str) -> DataFrame:
    """Number of cuts passed by each row, given the arrays of :func:`hash_cuts`."""
    here = F.struct(hash_order(seed, key).alias("h"), F.col(key).alias("k"))
    passed = F.filter("_cuts", lambda c: F.struct(c["h"], c["k"]) < here)
    return match(df, cuts, strata).withColumn(column, F.size(passed)).drop("_cuts", WHOLE)


def cumulative_by_value(df: DataFrame, by: Sequence[str], value: str, measures: Sequence[str]) -> DataFrame:
    """One row per group and distinct value with the sum of each measure and its sum over lower values.

    ``df`` may hold many rows per value; they are summed first (map side) and stored. The distinct values are then
    cut into ranges, as many as there are partitions, however the groups share them; sums per range are
    carried to the next ranges of the group. Output columns: the group, the value, each measure, and
    ``<measure>_below``. NULL is a group and a value like any other, the lowest.
    """
    by = list(by)
    distinct = store(df.groupBy(*by, value).agg(*[F.sum(m).alias(m) for m in measures]))
    placed = store(distinct.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = placed.groupBy(*by, "_range").agg(*[F.sum(m).alias(m) for m in measures])
    offsets = per_range.select(*by, "_range", *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_{m}") for m in measures])
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return match(placed, offsets, [*by, "_range"]).select(
        *by, value, *measures,
        *[(F.col(f"_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(f"{m}_below") for m in measures],
    )


def global_rank(df: DataFrame, order: str) -> DataFrame:
    """Add ``rank``: the 1-based position in the order of one column over the whole table.

    Rows are range-partitioned by the column and stored, so that both passes (rows per partition,
    then positions inside a partition) see the same partitions.
    """
    placed = store(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    before = Window.partitionBy().orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy("_part").orderBy(order)
    return placed.join(offsets, "_part").withColumn(
        "rank", F.col("_offset") + F.row_number().over(inside)).drop("_part", "_offset")
