"""Choosing rows of metric tables: operating points, best models, gates, selection scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.operators.ordering import match
from gradewell.session import store


def flag(condition: Column) -> Column:
    return condition.cast("int")


def best_rows(df: DataFrame, by: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """The best row per group under each rule; a rule is an ordering struct, the largest wins.

    One aggregation for all rules: ``max_by`` keeps one candidate per group and task.
    """
    row = F.struct(*[F.col(c) for c in df.columns if c not in by])
    winners = df.groupBy(*by).agg(*[F.max_by(row, key).alias(name) for name, key in rules.items()])
    named = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("r")) for name in rules])
    return winners.select(*by, F.inline(named)).select(*by, "rule", "r.*")


def operating_rules(target_recall: float = K.TARGET_RECALL, target_fp: float = K.TARGET_FALSE_POSITIVES) -> dict[str, Column]:
    """The published ways of choosing a threshold. Ties fall to the lowest threshold."""
    recall, f1, bal = F.col("recall"), F.col("f1"), F.col("balanced_accuracy")
    fn, fp, low = -F.col("false_negatives"), -F.col("false_positives"), -F.col("threshold")
    safe = (recall >= K.SAFETY_RECALL) & (fn >= -K.SAFETY_FALSE_NEGATIVES) & (fp >= -K.FALSE_POSITIVE_LIMIT)
    excess = F.greatest(F.lit(0), F.col("false_positives") - K.FALSE_POSITIVE_LIMIT)
    score = recall * 2 + bal - F.col("false_positives") / 10000.0
    strict = (recall >= 0.9665) & (fn >= -53)
    return {
        "recall_first": F.struct(recall, f1, fn, fp, low),
        "target_recall_then_f1": F.struct(flag(recall >= target_recall), f1, bal, fp, low),
        "production_recall": F.struct(flag(recall >= K.PRODUCTION_BASELINE["recall"]), recall, bal, f1, fn, fp, low),
        "fewest_misses": F.struct(flag(recall >= K.SAFETY_RECALL), fn, bal, f1, fp, low),
        # Rows inside the safety limits win by fewest false alarms; without any, by fewest misses.
        "safety_filtered": F.struct(
            flag(safe), F.when(safe, fp).otherwise(flag(recall >= K.SAFETY_RECALL)), fn,
            F.when(safe, recall).otherwise(-excess.cast("double")), bal, f1, low),
        "weighted_score": F.struct(flag(strict), score, low),
        "high_recall": F.struct(recall, low),
        "balanced": F.struct(bal, low),
        "low_false_positives": F.struct(fp, f1, low),
        "closest_to_baseline": F.struct(
            -F.abs(recall - target_recall), -F.abs(F.col("false_positives") - target_fp), low),
    }


def operating_points(sweep: DataFrame, by: Sequence[str]) -> DataFrame:
    return best_rows(sweep, by, operating_rules())


def grading_score() -> Column:
    """Weighted selection score of a 5-grade metric row."""
    recall = {i: F.col(f"class_{i}_recall") for i in K.GRADES}
    return (0.30 * F.col("macro_f1") + 0.25 * F.col("balanced_accuracy") + 0.15 * recall[3] + 0.10 * recall[1]
            + 0.10 * recall[4] + 0.10 * F.least(recall[0], recall[2]))


def binary_score(n_pos: Column) -> Column:
    """Weighted selection score of a binary metric row; misses count against it."""
    return (0.45 * F.col("recall") + 0.25 * F.col("balanced_accuracy") + 0.20 * F.col("f1")
            - 0.10 * (F.col("false_negatives") / F.greatest(n_pos, F.lit(1))))


def report_score() -> Column:
    """Selection score of the summary report: macro F1 counts twice, grade 3 recall a quarter."""
    return (F.coalesce("macro_f1", F.lit(0.0)) * 2 + F.coalesce("balanced_accuracy", F.lit(0.0))
            + F.coalesce("class_3_recall", F.lit(0.0)) * 0.25)


def grading_rules(name: str = "model") -> dict[str, Column]:
    """The published ways of choosing a grading model; ties fall to the first name."""
    macro, bal, acc = F.col("macro_f1"), F.col("balanced_accuracy"), F.col("accuracy")
    first = F.col("_first")
    return {
        "selection_score": F.struct(grading_score(), first),
        "safe_then_macro_f1": F.struct(
            flag(F.col("class_3_recall") >= K.SAFE_GRADING_BASELINE["class_3_recall"]), macro, bal, acc, first),
        "macro_f1": F.struct(macro, first),
        "report_score": F.struct(report_score(), first),
    }


def best_models(metrics: DataFrame, by: Sequence[str] = (), name: str = "model") -> DataFrame:
    """Best model under each rule; the table has one row per model, so one task may order it."""
    by = list(by)
    order = Window.partitionBy(*by).orderBy(F.col(name).desc())
    return best_rows(metrics.withColumn("_first", F.row_number().over(order)), by, grading_rules(name)).drop("_first")


def leaderboard(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rank of each candidate by F1, then recall, then quadratic kappa."""
    order = Window.partitionBy(*by).orderBy(
        F.desc("macro_f1"), F.desc("macro_recall"), F.desc("quadratic_kappa"), F.asc("model"))
    return metrics.withColumn("rank", F.row_number().over(order).cast("bigint"))


def grading_gates() -> dict[str, Column]:
    """Promotion rules of a grading model against the fixed baselines."""
    b, p = K.SAFE_GRADING_BASELINE, K.PRODUCTION_BASELINE
    macro, bal, acc = F.col("macro_f1"), F.col("balanced_accuracy"), F.col("accuracy")
    recall = {i: F.col(f"class_{i}_recall") for i in K.GRADES}
    improves = (macro > b["macro_f1"]) | (bal > b["balanced_accuracy"]) | (acc >= b["accuracy"] + 0.02)
    safe = ((recall[3] >= b["class_3_recall"]) & (recall[1] >= b["class_1_recall"] - 0.05)
            & (recall[4] >= b["class_4_recall"] - 0.05))
    return {
        "improves": improves,
        "safe_classes": safe,
        "replace_grading": improves & safe,
        "beats_production": ((macro > p["macro_f1"]) | (bal > p["balanced_accuracy"]))
        & (recall[3] > p["class_3_recall"]) & (recall[0] >= 0.70) & (recall[2] >= 0.45),
        "report_gate": (macro > 0.5799) & (bal > 0.6113) & (recall[3] >= 0.64),
    }


def screening_gates() -> dict[str, Column]:
    """Promotion rules of a binary operating point."""
    recall, fn, fp = F.col("recall"), F.col("false_negatives"), F.col("false_positives")
    return {
        "replace_screening": (recall >= K.SAFETY_RECALL) & (fn <= K.SAFETY_FALSE_NEGATIVES)
        & (fp <= K.FALSE_POSITIVE_LIMIT) & (F.col("uncertain_025_075") <= K.UNCERTAIN_SHARE_LIMIT),
        "beats_production": (recall >= K.PRODUCTION_BASELINE["recall"])
        & (fn <= K.PRODUCTION_BASELINE["false_negatives"]),
        "report_gate": (recall >= 0.9665) & (fn <= 53) & (fp < 900),
    }


def delta_to_baseline(metrics: DataFrame, baseline: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each metric minus its largest value in the baseline table, which usually has one row."""
    base = baseline.agg(*[F.max(c).alias(f"_{c}") for c in columns])
    return metrics.crossJoin(F.broadcast(base)).select(
        *metrics.columns, *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in columns])


def confusion_pairs(counts: DataFrame, by: Sequence[str], limit: int = 10) -> DataFrame:
    """Most frequent wrong (truth, prediction) pairs per group, farther grades first on equal counts."""
    wrong = counts.filter((F.col("y_true") != F.col("y_pred")) & (F.col("n") > 0))
    wrong = wrong.withColumn("distance", F.abs(F.col("y_true") - F.col("y_pred")))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), F.desc("distance"), "y_true", "y_pred")
    return wrong.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= limit)


def most_common_wrong(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The wrong prediction each class is most often given; the lowest label on equal counts."""
    wrong = counts.filter((F.col("y_true") != F.col("y_pred")) & (F.col("n") > 0))
    return wrong.groupBy(*by, "y_true").agg(
        F.max_by("y_pred", F.struct("n", -F.col("y_pred"))).alias("wrong_pred"), F.max("n").alias("n"))


def running_best(trials: DataFrame, by: Sequence[str], trial: str, value: str, state: str) -> DataFrame:
    """Trial log with the best value of the completed trials so far."""
    # Ranges of trials in order, however many one model has; the best of earlier ranges is carried along.
    placed = store(trials.repartitionByRange(*by, trial).withColumn("_range", F.spark_partition_id()))
    done = F.when(F.col(state) == "COMPLETE", F.col(value))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy(*by, "_range").agg(F.max(done).alias("_best")).select(*by, "_range", F.max("_best").over(earlier).alias("_carried"))
    inside = Window.partitionBy(*by, "_range").orderBy(trial).rowsBetween(Window.unboundedPreceding, 0)
    return match(placed, carried, [*by, "_range"]).withColumn("best_value", F.greatest(F.max(done).over(inside), F.col("_carried"))).drop("_range", "_carried")


def best_trial(trials: DataFrame, by: Sequence[str], trial: str, value: str, state: str, min_trials: int = 1) -> DataFrame:
    """The best completed trial per model, the first on ties; only models with enough completed trials."""
    done = trials.filter((F.col(state) == "COMPLETE"))
    row = F.struct(*[c for c in trials.columns if c not in by])
    best = done.groupBy(*by).agg(
        F.max_by(row, F.when(F.col(value).isNotNull(), F.struct(F.col(value), -F.col(trial)))).alias("r"),
        F.count(F.lit(1)).alias("n_completed"))
    return best.filter((F.col("n_completed") >= min_trials) & F.col("r").isNotNull()).select(*by, "n_completed", "r.*")
