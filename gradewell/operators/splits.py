"""Stratified splits, folds and samples by hash order.

Membership is decided by comparing the hash of a row with a few cut points, which are found from
bucket counts. The table itself is neither sorted nor shuffled, and the result is the same in every
engine and for every partitioning of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.operators.ordering import apply_cuts, assign_blocks, bucket_sizes, hash_cuts
from gradewell.session import settle


def stratum_counts(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    return settle(df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")))


def bucket_totals(sizes: DataFrame, strata: Sequence[str]) -> DataFrame:
    return sizes.groupBy(*strata).agg(F.sum("_n").alias("n"))


def apportion(counts: DataFrame, strata: Sequence[str], draws: Column, size: str = "n") -> DataFrame:
    """Largest-remainder shares of ``draws`` among the strata, in whole rows, as ``take``.

    Products of two row counts can pass 64 bits, so they are decimals.
    """
    everything = Window.partitionBy()
    wide = counts.withColumn("_total", F.sum(size).over(everything)).withColumn("_draws", draws.cast("decimal(19,0)"))
    product = F.col(size).cast("decimal(19,0)") * F.col("_draws")
    wide = wide.withColumn("_product", product).withColumn("_left", F.expr("_product % cast(_total as decimal(19,0))"))
    wide = wide.withColumn("_base", F.expr("_product div cast(_total as decimal(19,0))"))
    wide = wide.withColumn("_missing", F.col("_draws") - F.sum("_base").over(everything))
    order = Window.partitionBy().orderBy(F.desc("_left"), *strata)
    extra = (F.row_number().over(order) <= F.col("_missing")).cast("bigint")
    return wide.withColumn("take", F.col("_base") + extra).drop(
        "_total", "_draws", "_product", "_left", "_base", "_missing")


def split_targets(counts: DataFrame, strata: Sequence[str], test: float, validation: float) -> DataFrame:
    """Rank up to which rows belong to test and, of the remainder, to validation."""
    everything = Window.partitionBy()
    total = F.sum("n").over(everything)
    tested = apportion(counts.withColumn("_d", F.ceil(total * test)), strata, F.col("_d")).withColumnRenamed("take", "n_test")
    rest = tested.withColumn("_rest", F.col("n") - F.col("n_test"))
    rest = rest.withColumn("_d", F.ceil(F.sum("_rest").over(everything) * validation))
    both = apportion(rest, strata, F.col("_d"), "_rest").withColumnRenamed("take", "n_val")
    cuts = F.array(
        F.struct(F.lit(0).alias("cut"), F.col("n_test").alias("upto")),
        F.struct(F.lit(1).alias("cut"), (F.col("n_test") + F.col("n_val")).alias("upto")))
    return both.select(*strata, F.inline(cuts))


def stratified_split(df: DataFrame, strata: Sequence[str], key: str, test: float = 0.20, validation: float = 0.20,
                     seed: int = K.SEED) -> DataFrame:
    """Add ``split``: test first, then the validation share of the remainder, the rest is train.

    ``validation`` is a fraction of what test leaves over: 0.20/0.20, or 0.15 and 0.15/0.85.
    """
    sizes = bucket_sizes(df, strata, key, seed)
    targets = split_targets(bucket_totals(sizes, strata), strata, test, validation)
    blocks = assign_blocks(df, strata, key, seed, targets, sizes=sizes)
    name = F.when(F.col("block") == 0, "test").when(F.col("block") == 1, "val").otherwise("train")
    return blocks.withColumn("split", name).drop("block")


def effective_folds(counts: DataFrame, folds: int) -> int:
    """At most the size of the smallest class, at least 2."""
    smallest = counts.agg(F.min("n")).first()[0]
    return max(2, min(folds, int(smallest)))


def stratified_folds(df: DataFrame, strata: Sequence[str], key: str, folds: int = 5, seed: int = K.SEED) -> DataFrame:
    """Add ``fold`` 0..k-1; fold sizes within a stratum differ by at most one row."""
    sizes = bucket_sizes(df, strata, key, seed)
    counts = bucket_totals(sizes, strata)
    k = effective_folds(counts, folds)
    cuts = F.array(*[
        F.struct(F.lit(i).alias("cut"),
                 (F.expr(f"n div {k}") * (i + 1) + F.least(F.lit(i + 1), F.col("n") % k)).alias("upto"))
        for i in range(k - 1)])
    targets = counts.select(*strata, F.inline(cuts))
    return assign_blocks(df, strata, key, seed, targets, "fold", sizes=sizes)


def group_split(df: DataFrame, group: str, test: float = 0.20, validation: float = 0.20, seed: int = K.SEED) -> DataFrame:
    """Split by group (person, content hash): all rows of a group fall on one side.

    Cuts are taken over the distinct groups; rows compare the hash of their own group, so a group
    holding a third of the table needs no join.
    """
    whole = df.withColumn("_whole", F.lit(0))
    groups = whole.select("_whole", group).distinct()
    sizes = bucket_sizes(groups, ["_whole"], group, seed)
    targets = split_targets(bucket_totals(sizes, ["_whole"]), ["_whole"], test, validation)
    cuts = hash_cuts(groups, ["_whole"], group, seed, targets, sizes=sizes)
    blocks = apply_cuts(whole, ["_whole"], group, seed, cuts, "block")
    name = F.when(F.col("block") == 0, "test").when(F.col("block") == 1, "val").otherwise("train")
    return blocks.withColumn("split", name).drop("block")


def require_classes(counts: DataFrame, labels: Sequence[int], minimum: int, label: str = "label") -> None:
    """Raise unless every class of ``labels`` that occurs has ``minimum`` rows and two classes occur."""
    found = {row[label]: row["n"] for row in counts.collect() if row[label] in labels}
    if len(found) < 2:
        raise ValueError("at least two classes are needed")
    short = {k: n for k, n in sorted(found.items()) if n < minimum}
    if short:
        raise ValueError(f"classes with fewer than {minimum} rows: {short}")


def split_overlaps(df: DataFrame, key: str, split: str = "split", names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Keys shared by each pair of splits, by one aggregation on the key."""
    seen = df.groupBy(key).agg(*[F.max((F.col(split) == s).cast("int")).alias(s) for s in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    counted = seen.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}") for a, b in pairs])
    rows = [F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), F.col(f"{a}_{b}").alias("n_shared"))
            for a, b in pairs]
    return counted.select(F.inline(F.array(*rows))).withColumn("disjoint", F.col("n_shared") == 0)


def split_report(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Rows per split and class with the share of the class in the split."""
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    size = F.sum("n").over(Window.partitionBy(split))
    return counts.withColumns({"split_size": size, "share": F.col("n") / size})


def fold_summary(metrics: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean and population deviation over folds; NaN and -inf count as 0, +inf as 1."""
    def clean(name: str) -> Column:
        c = F.col(name)
        return F.when(F.isnan(c) | (c == float("-inf")), 0.0).when(c == float("inf"), 1.0).otherwise(c)

    long = metrics.select(*by, F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), clean(n).alias("v")) for n in names])))
    return long.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def confidence_interval(metrics: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean and its 95 % interval, mean +- 1.96 s / sqrt(n); s is 0 for a single value."""
    long = metrics.select(*by, F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])))
    stats = long.groupBy(*by, "metric").agg(
        F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.count("v").alias("_n"))
    margin = F.lit(1.96) * F.col("std") / F.sqrt("_n")
    return stats.select(*by, "metric", "mean", "std", (F.col("mean") - margin).alias("ci95_low"),
                        (F.col("mean") + margin).alias("ci95_high"))


def class_weights(df: DataFrame, label: str, classes: int | None = None) -> DataFrame:
    """Balanced weight n / (k * n_c) per class that is not NULL; k is the number of classes present unless given."""
    counts = stratum_counts(df.filter(F.col(label).isNotNull()), [label])
    total = F.sum("n").over(Window.partitionBy())
    k = F.lit(classes) if classes else F.count(F.lit(1)).over(Window.partitionBy())
    return counts.select(label, "n", (total / (k * F.col("n"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str, classes: int | None = None) -> DataFrame:
    """Every row with the weight of its class; rows without a label keep a NULL weight."""
    return df.join(settle(class_weights(df, label, classes).select(label, "weight")), label, "left")


def positive_weight(df: DataFrame, positive: Column) -> DataFrame:
    """n0 / n1 for losses that weigh the positive class."""
    n1 = F.count_if(positive)
    return df.agg((F.count_if(~positive) / F.greatest(n1, F.lit(1))).alias("pos_weight"))


# -- samples -----------------------------------------------------------------------------------

def sample_rows(df: DataFrame, key: str, n: int, seed: int = K.SEED) -> DataFrame:
    """n rows chosen by hash order, always the same ones."""
    targets = df.sparkSession.createDataFrame([(0, n)], "cut int, upto bigint")
    return assign_blocks(df, [], key, seed, targets).filter("block = 0").drop("block")


def _take_per_class(df: DataFrame, label: str, key: str, per_class: Column, seed: int) -> DataFrame:
    counts = stratum_counts(df, [label])
    classes = F.count(F.lit(1)).over(Window.partitionBy())
    targets = counts.withColumn("_k", classes).select(label, F.lit(0).alias("cut"), per_class.alias("upto"))
    return assign_blocks(df, [label], key, seed, settle(targets))


def stratified_cap(df: DataFrame, label: str, key: str, limit: int, seed: int = K.SEED) -> DataFrame:
    """At most limit / classes random rows per class; tables within the limit stay whole."""
    if limit <= 0 or df.count() <= limit:
        return df
    share = F.greatest(F.lit(1), F.expr(f"{limit} div _k"))
    return _take_per_class(df, label, key, share, seed).filter("block = 0").drop("block")


def balanced_sample(df: DataFrame, label: str, key: str, limit: int, seed: int = K.SEED) -> DataFrame:
    """limit / classes rows per class, topped up from the remaining rows when classes are short."""
    share = F.greatest(F.lit(1), F.expr(f"{limit} div _k"))
    first = _take_per_class(df, label, key, share, seed)
    taken = first.agg(F.count_if(F.col("block") == 0)).first()[0]
    rest = first.filter("block > 0").drop("block")
    if taken >= limit:
        return first.filter("block = 0").drop("block")
    return first.filter("block = 0").drop("block").unionByName(sample_rows(rest, key, limit - taken, seed))


def first_per_class(df: DataFrame, label: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows per class in key order.

    ``row_number() <= n`` is cut to n rows per class in every task before the shuffle.
    """
    w = Window.partitionBy(label).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
