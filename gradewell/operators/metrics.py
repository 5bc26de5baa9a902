"""Evaluation over prediction tables, many models and sources at once.

Rows are counted once per (group, truth, prediction) with map-side combine; every metric is then an
expression over the cells of that small table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.functions.numeric import total, zero_div
from gradewell.operators.ordering import cumulative_by_value, match
from gradewell.session import settle


def cell(i: int, j: int) -> Column:
    return F.col(f"c_{i}_{j}")


def confusion_wide(df: DataFrame, by: Sequence[str], labels: Sequence[int] = K.GRADES,
                   truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """One row per group with a zero-filled cell ``c_<truth>_<prediction>`` per label pair.

    Also the marginals ``support_<label>`` and ``predicted_<label>``, the row count and the sums the
    error and kappa formulas need.
    """
    counts = df.groupBy(*by, F.col(truth).alias("_t"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    listed = ", ".join(str(i) for i in labels)
    known = f"(_t in ({listed}) and _p in ({listed}))"

    def tally(condition: str, name: str, value: str = "_n") -> Column:
        return F.expr(f"coalesce(sum(case when {condition} then {value} end), 0) as {name}")

    # As SQL text: one call into the JVM per column, however many operators a column has.
    return counts.groupBy(*by).agg(
        *[tally(f"_t = {i} and _p = {j}", f"c_{i}_{j}") for i in labels for j in labels],
        *[tally(f"{known} and _t = {i}", f"support_{i}") for i in labels],
        *[tally(f"{known} and _p = {i}", f"predicted_{i}") for i in labels],
        F.sum("_n").alias("n_rows"), tally(known, "n_known"), F.expr("sum(abs(_t - _p) * _n) as abs_error"),
        tally(known, "square_error", "(_t - _p) * (_t - _p) * _n"), tally(known, "squares", "(_t * _t + _p * _p) * _n"),
        tally(known, "sum_true", "_t * _n"), tally(known, "sum_pred", "_p * _n"),
    )


def confusion_long(wide: DataFrame, by: Sequence[str], labels: Sequence[int] = K.GRADES) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("y_true"), F.lit(j).alias("y_pred"), cell(i, j).alias("n"))
            for i in labels for j in labels]
    return wide.select(*by, F.inline(F.array(*rows)))


def support(i: int) -> Column:
    return F.col(f"support_{i}")


def predicted(i: int) -> Column:
    return F.col(f"predicted_{i}")


def ratio_sql(n: str, d: str) -> str:
    """SQL text of n / d, and 0 where d is 0."""
    return f"(case when {d} <> 0 then cast({n} as double) / {d} else 0.0D end)"


def precision_sql(i: int) -> str:
    return ratio_sql(f"c_{i}_{i}", f"predicted_{i}")


def recall_sql(i: int) -> str:
    return ratio_sql(f"c_{i}_{i}", f"support_{i}")


def f1_sql(i: int) -> str:
    return ratio_sql(f"(2 * c_{i}_{i})", f"(support_{i} + predicted_{i})")


def class_precision(i: int) -> Column:
    return F.expr(precision_sql(i))


def class_recall(i: int) -> Column:
    return F.expr(recall_sql(i))


def class_f1(i: int) -> Column:
    return F.expr(f1_sql(i))


def per_class(wide: DataFrame, by: Sequence[str], labels: Sequence[int] = K.GRADES) -> DataFrame:
    """Precision, recall, F1, support and correct per class; 0 where a denominator is 0."""
    rows = [
        F.struct(
            F.lit(i).alias("label"), class_precision(i).alias("precision"),
            class_recall(i).alias("recall"), class_f1(i).alias("f1"),
            support(i).alias("support"), cell(i, i).alias("correct"),
        ) for i in labels
    ]
    return wide.select(*by, F.inline(F.array(*rows)))


def one_vs_rest(wide: DataFrame, by: Sequence[str], labels: Sequence[int] = K.GRADES) -> DataFrame:
    """Sensitivity and specificity per class with denominators of at least 1."""
    rows = []
    for i in labels:
        tp, negatives = cell(i, i), F.col("n_known") - support(i)
        rows.append(F.struct(
            F.lit(i).alias("label"),
            (tp / F.greatest(support(i), F.lit(1))).alias("sensitivity"),
            ((negatives - (predicted(i) - tp)) / F.greatest(negatives, F.lit(1))).alias("specificity"),
        ))
    return wide.select(*by, F.inline(F.array(*rows)))


def _averaged(per_label: Callable[[int], str], labels: Sequence[int], only_present: bool) -> Column:
    """Mean over all labels, or over the labels that occur in the truth."""
    if not only_present:
        return F.expr(f"({' + '.join(per_label(i) for i in labels)}) / {len(labels)}")
    present = " + ".join(f"cast(support_{i} > 0 as int)" for i in labels)
    weighted = " + ".join(f"(case when support_{i} > 0 then {per_label(i)} else 0.0D end)" for i in labels)
    return F.expr(ratio_sql(f"({weighted})", f"({present})"))


def accuracy(labels: Sequence[int]) -> Column:
    return F.expr(ratio_sql("(" + " + ".join(f"c_{i}_{i}" for i in labels) + ")", "n_rows"))


def balanced_accuracy(labels: Sequence[int]) -> Column:
    return _averaged(recall_sql, labels, only_present=True)


def cohen_kappa(labels: Sequence[int]) -> Column:
    """Agreement beyond chance; NULL when chance agreement is certain."""
    n = "cast(n_known as double)"
    observed = f"(({' + '.join(f'c_{i}_{i}' for i in labels)}) / {n})"
    chance = f"(({' + '.join(f'cast(support_{i} as double) * predicted_{i}' for i in labels)}) / ({n} * {n}))"
    return F.expr(f"case when {chance} <> 1 then 1 - (1 - {observed}) / (1 - {chance}) end")


def quadratic_kappa() -> Column:
    """1 - squared disagreement / its expectation under independent marginals, both as moments."""
    expected = F.col("squares") - 2.0 * F.col("sum_true") * F.col("sum_pred") / F.col("n_known")
    return F.when(expected != 0, 1 - F.col("square_error") / expected)


def summary_metrics(wide: DataFrame, by: Sequence[str], labels: Sequence[int] = K.GRADES,
                    only_present: bool = False) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted averages, kappas and mean grade error."""
    weighted_f1 = F.expr(ratio_sql("(" + " + ".join(f"{f1_sql(i)} * support_{i}" for i in labels) + ")", "n_known"))
    return wide.select(
        *by, "n_rows",
        accuracy(labels).alias("accuracy"),
        balanced_accuracy(labels).alias("balanced_accuracy"),
        _averaged(precision_sql, labels, only_present).alias("macro_precision"),
        _averaged(recall_sql, labels, only_present).alias("macro_recall"),
        _averaged(f1_sql, labels, only_present).alias("macro_f1"),
        weighted_f1.alias("weighted_f1"),
        cohen_kappa(labels).alias("cohen_kappa"),
        quadratic_kappa().alias("quadratic_kappa"),
        zero_div(F.col("abs_error"), F.col("n_rows")).alias("mean_abs_error"),
        *[class_recall(i).alias(f"class_{i}_recall") for i in labels],
    )


def evaluate(df: DataFrame, by: Sequence[str], labels: Sequence[int] = K.GRADES, only_present: bool = False,
             truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return summary_metrics(confusion_wide(df, by, labels, truth, pred), by, labels, only_present)


def binary_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """The binary metric set from the four cells."""
    recall, specificity = zero_div(tp, tp + fn), zero_div(tn, tn + fp)
    present = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    return {
        "accuracy": zero_div(tp + tn, tp + fp + fn + tn),
        "balanced_accuracy": zero_div(recall + specificity, present),
        "precision": zero_div(tp, tp + fp),
        "recall": recall,
        "f1": zero_div(2 * tp, 2 * tp + fp + fn),
        "negative_recall": specificity,
        "false_negatives": fn,
        "false_positives": fp,
    }


def binary_from_grades(df: DataFrame, by: Sequence[str], min_grade: int = K.POSITIVE_MIN_GRADE,
                       truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Positive recall, misses and the other binary metrics derived from grade predictions."""
    wide = confusion_wide(
        df.select(*by, (F.col(truth) >= min_grade).cast("int").alias("y_true"),
                  (F.col(pred) >= min_grade).cast("int").alias("y_pred")), by, [0, 1])
    metrics = binary_columns(cell(1, 1), cell(0, 1), cell(1, 0), cell(0, 0))
    return wide.select(*by, "n_rows", *[c.alias(name) for name, c in metrics.items()])


# -- ranking metrics ---------------------------------------------------------------------------

def score_counts(df: DataFrame, by: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Positives and negatives per group and score, and those at lower scores."""
    counted = df.select(*by, F.col(score).alias("score"), positive.cast("bigint").alias("pos"),
                        (~positive).cast("bigint").alias("neg"))
    return cumulative_by_value(counted, by, "score", ["pos", "neg"])


def auc(df: DataFrame, by: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve with ties counted one half; NULL when one class is missing."""
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return score_counts(df, by, score, positive).groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.when(pairs > 0, wins / pairs).alias("auc"))


def long_probabilities(df: DataFrame, by: Sequence[str], labels: Sequence[int] = K.GRADES,
                       truth: str = "y_true", prob: str = "prob") -> DataFrame:
    """One row per prediction and class: the class, its probability and whether it is the truth."""
    rows = [F.struct(F.lit(k).alias("label"), F.col(prob)[i].alias("p"), (F.col(truth) == k).alias("hit"))
            for i, k in enumerate(labels)]
    return df.select(*by, F.inline(F.array(*rows)))


def class_auc(df: DataFrame, by: Sequence[str], labels: Sequence[int] = K.GRADES) -> DataFrame:
    return auc(long_probabilities(df, by, labels), [*by, "label"], "p", F.col("hit"))


def macro_auc(df: DataFrame, by: Sequence[str], labels: Sequence[int] = K.GRADES) -> DataFrame:
    """Mean one-vs-rest AUC over the classes in the truth; 0 with fewer than two classes."""
    per_label = class_auc(df, by, labels)
    present = F.col("n_pos") > 0
    return per_label.groupBy(*by).agg(
        F.when(F.sum(present.cast("int")) >= 2, F.avg(F.when(present, F.col("auc")))).otherwise(0.0).alias("macro_auc"))


def roc_points(df: DataFrame, by: Sequence[str], score: str, positive: Column) -> DataFrame:
    """False and true positive rates per distinct score, the score being the lowest accepted one."""
    counts = score_counts(df, by, score, positive)
    totals = settle(df.groupBy(*by).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n")))
    return match(counts, totals, by).select(
        *by, "score",
        (F.col("_p") - F.col("pos_below")).alias("tp"), (F.col("_n") - F.col("neg_below")).alias("fp"),
        zero_div(F.col("_p") - F.col("pos_below"), F.col("_p")).alias("tpr"),
        zero_div(F.col("_n") - F.col("neg_below"), F.col("_n")).alias("fpr"),
    )


def brier(df: DataFrame, by: Sequence[str], score: str, positive: Column, labels: Sequence[int] = K.GRADES,
          truth: str = "y_true", prob: str = "prob") -> DataFrame:
    """Binary mean (p - y)^2 and multiclass mean of the summed squared errors (0 to 2)."""
    binary = F.pow(F.col(score) - positive.cast("double"), 2)
    multi = total([F.pow(F.col(prob)[i] - (F.col(truth) == k).cast("double"), 2) for i, k in enumerate(labels)])
    return df.groupBy(*by).agg(F.avg(binary).alias("brier_binary"), F.avg(multi).alias("brier_multiclass"))


def log_loss(df: DataFrame, by: Sequence[str], score: str, positive: Column, floor: float = 1e-6) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(floor)), F.lit(1 - floor))
    return df.groupBy(*by).agg(F.avg(F.when(positive, -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss"))


# -- thresholds --------------------------------------------------------------------------------

def band_column(low: float, high: float) -> str:
    return f"uncertain_{low:.2f}_{high:.2f}".replace(".", "")


def threshold_sweep(df: DataFrame, by: Sequence[str], score: str, positive: Column, thresholds: Sequence[float],
                    bands: Sequence[tuple[float, float]] = K.UNCERTAINTY_BANDS, with_auc: bool = True) -> DataFrame:
    """Full binary metrics per group and threshold in one pass over the rows.

    A row is counted once, under the number of thresholds it reaches; the rows of each threshold are
    then sums over at most ``len(thresholds) + 1`` counters per group.
    """
    grid = sorted(thresholds)
    s = F.col(score)
    confident = F.greatest(s, 1 - s)
    counters = df.groupBy(*by, total([(s >= t).cast("int") for t in grid]).alias("_reached")).agg(
        F.sum(positive.cast("bigint")).alias("_pos"), F.sum((~positive).cast("bigint")).alias("_neg"),
        F.count_if(confident < K.LOW_CONFIDENCE).alias("_low"),
        *[F.count_if((s >= lo) & (s <= hi)).alias(f"_{band_column(lo, hi)}") for lo, hi in bands],
    )
    n = (F.sum("_pos") + F.sum("_neg")).cast("double")
    whole = counters.groupBy(*by).agg(
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"),
        *[F.coalesce(F.sum(F.when(F.col("_reached") > i, F.col(f"_{side}"))), F.lit(0)).alias(f"_{side}_{i}")
          for i in range(len(grid)) for side in ("pos", "neg")],
        (F.sum("_low") / n).alias("uncertain_below_060"),
        *[(F.sum(f"_{band_column(lo, hi)}") / n).alias(band_column(lo, hi)) for lo, hi in bands],
    )
    rows = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_pos_{i}").alias("tp"), F.col(f"_neg_{i}").alias("fp"))
            for i, t in enumerate(grid)]
    shares = ["uncertain_below_060", *[band_column(lo, hi) for lo, hi in bands]]
    flat = whole.select(*by, "_p", "_n", *shares, F.inline(F.array(*rows)))
    tp, fp = F.col("tp"), F.col("fp")
    metrics = binary_columns(tp, fp, F.col("_p") - tp, F.col("_n") - fp)
    swept = flat.select(*by, "threshold", *[c.alias(name) for name, c in metrics.items()], *shares)
    if not with_auc:
        return swept
    return match(swept, auc(df, by, score, positive).select(*by, "auc"), by)


def ordinal_grade(value: Column, cuts: Sequence[float], top: int = 4) -> Column:
    """Number of cut points strictly below the value, at most ``top``."""
    return F.least(total([(value > c).cast("int") for c in cuts]), F.lit(top))


def compare_cut_sets(df: DataFrame, by: Sequence[str], value: str, truth: str,
                     cut_sets: dict[str, Sequence[float]]) -> DataFrame:
    """Metrics of each named set of cut points, in one pass over the rows."""
    rows = [F.struct(F.lit(name).alias("cut_set"), ordinal_grade(F.col(value), cuts).alias("y_pred"))
            for name, cuts in cut_sets.items()]
    graded = df.select(*by, F.col(truth).alias("y_true"), F.inline(F.array(*rows)))
    return evaluate(graded, [*by, "cut_set"], K.GRADES)


def optimise_cuts(df: DataFrame, by: Sequence[str], value: str, truth: str, start: Sequence[float],
                  grids: Sequence[Sequence[float]], passes: int = 1) -> DataFrame:
    """Coordinate search for the cut points with the highest quadratic kappa, per group: (by, position, cut, quadratic_kappa).

    Rows are reduced once to counts per (group, truth, interval between grid values): no candidate can tell
    two values of one interval apart. The search of a group then looks at its counters alone.
    """
    by = list(by)
    edges = sorted({round(v, 6) for grid in grids for v in grid} | set(start))
    passed = total([(F.col(value) > e).cast("int") for e in edges])
    counters = df.filter(F.col(truth).isNotNull()).groupBy(*by, F.col(truth).cast("int").alias("t"), passed.alias("e")).agg(
        F.count(F.lit(1)).alias("n"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        t, e, n = (rows[c].to_numpy(dtype=float) for c in ("t", "e", "n"))

        def kappa(cuts: Sequence[float]) -> float:
            p = np.minimum(sum((e > edges.index(c)).astype(float) for c in cuts), 4)
            apart = ((t - p) ** 2 * n).sum()
            chance = ((t * t + p * p) * n).sum() - 2 * (t * n).sum() * (p * n).sum() / n.sum()
            return 1 - apart / chance if chance else float("-inf")

        best = list(start)
        best_score = kappa(best)
        for position, grid in [(i, g) for _ in range(passes) for i, g in enumerate(grids)]:
            for v in grid:
                cuts = [*best[:position], round(v, 6), *best[position + 1:]]
                if all(a < b for a, b in zip(cuts, cuts[1:])) and (score := kappa(cuts)) > best_score:
                    best, best_score = cuts, score
        out = pd.DataFrame({"position": range(len(best)), "cut": best, "quadratic_kappa": best_score})
        for name in reversed(by):
            out.insert(0, name, rows[name].iloc[0])
        return out

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in counters.schema.fields if f.name in by)
    return counters.groupBy(*by).applyInPandas(search, f"{kinds}position int, cut double, quadratic_kappa double")
