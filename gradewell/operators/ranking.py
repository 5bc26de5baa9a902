"""Ranking of features and of selection candidates. Tables here have one row per feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell import constants as K


def clean_score(score: Column) -> Column:
    """NaN, infinities and NULL count as 0."""
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, 0.0).otherwise(score)


def rank_features(scores: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """1-based rank by cleaned score, per method."""
    cleaned = scores.withColumn(score, clean_score(F.col(score)))
    order = Window.partitionBy(*by).orderBy(F.desc(score), "feature")
    return cleaned.withColumn("rank", F.row_number().over(order).cast("bigint"))


def normalise_scores(scores: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Negative scores count as 0; the rest add up to 1 per method, or stay 0."""
    positive = F.greatest(clean_score(F.col(score)), F.lit(0.0))
    whole = F.sum(positive).over(Window.partitionBy(*by))
    return scores.withColumn("share", F.when(whole > 0, positive / whole).otherwise(0.0))


def top_subsets(ranked: DataFrame, sizes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Ordered feature lists of each size and of all features; sizes beyond the table are its length."""
    options = F.array(*[F.struct(F.lit(f"top_{n}").alias("feature_set"), F.lit(n).alias("_size")) for n in sizes],
                      F.struct(F.lit("all").alias("feature_set"), F.lit(None).cast("int").alias("_size")))
    chosen = ranked.select(*by, "feature", "rank", F.inline(options)).filter("_size is null or rank <= _size")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "feature")))
    return chosen.groupBy(*by, "feature_set").agg(F.transform(ordered, lambda x: x["feature"]).alias("features"))


def greedy_subset(ranked: DataFrame, pairs: DataFrame, limit: int | None, cut: float = 0.985) -> list[str]:
    """Features in rank order, leaving out any whose |correlation| with a chosen one reaches the cut.

    The choice depends on every earlier choice; both tables are as small as the feature list.
    """
    order = [r["feature"] for r in ranked.orderBy("rank").select("feature").collect()]
    close: dict[str, set[str]] = {}
    for r in pairs.filter(F.col("correlation") >= cut).collect():
        close.setdefault(r["feature_a"], set()).add(r["feature_b"])
        close.setdefault(r["feature_b"], set()).add(r["feature_a"])
    chosen: list[str] = []
    for feature in order:
        if limit is not None and len(chosen) >= limit:
            break
        if close.get(feature, set()).isdisjoint(chosen):
            chosen.append(feature)
    return chosen


# Weights of the consensus scores (fixed values).
CONSENSUS_THREE = {"random_forest": 0.40, "boosting": 0.40, "permutation": 0.20}
CONSENSUS_FOUR = {"random_forest": 0.32, "boosting": 0.32, "permutation": 0.18, "explained": 0.18}
CONSENSUS_FIVE = {"random_forest": 0.25, "boosting": 0.25, "permutation": 0.15, "mutual_info": 0.20, "anova_f": 0.15}


def consensus(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of the normalised scores of several methods; a missing score counts as 0."""
    shares = normalise_scores(scores, ["method"])
    parts = [F.coalesce(F.max(F.when(F.col("method") == m, F.col("share"))), F.lit(0.0)).alias(m) for m in weights]
    wide = shares.groupBy("feature").agg(*parts)
    combined = F.lit(0.0)
    for method, weight in weights.items():
        combined = combined + F.lit(weight) * F.col(method)
    return wide.withColumn("combined", combined)


def candidate_rank(source: Column, path: Column, source_ranks: dict[str, int] = K.SOURCE_RANKS) -> list[Column]:
    """Sort keys of selection candidates: trusted sources, then originals, then train before val before test, then path."""
    rank = F.lit(9)
    for name, value in source_ranks.items():
        rank = F.when(source == name, value).otherwise(rank)
    lower = F.lower(path)
    parts = F.split(lower, "/")
    augmented = F.element_at(parts, -1).contains("_aug_").cast("int")
    folder = (F.when(F.array_contains(parts, "train"), 0).when(F.array_contains(parts, "val"), 1)
              .when(F.array_contains(parts, "test"), 2).otherwise(0))
    return [rank.alias("source_rank"), augmented.alias("augmented_rank"), folder.alias("split_rank"), lower.alias("path_key")]
