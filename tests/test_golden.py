"""Published tables fed through the metric layer and the split sizes."""

import pytest
from pyspark.sql import functions as F

from gradewell.operators import metrics as M
from gradewell.operators import profile as P
from gradewell.operators import splits as S

FIVE = [[1298, 62, 202, 5, 26], [48, 64, 71, 1, 10], [167, 112, 635, 48, 120], [3, 5, 20, 26, 30], [9, 4, 63, 16, 147]]
TWO = [[1216, 572], [88, 1316]]


def rows(spark, matrix):
    cells = [(i, j, n) for i, line in enumerate(matrix) for j, n in enumerate(line)]
    table = spark.createDataFrame(cells, "y_true int, y_pred int, n int")
    return table.select("y_true", "y_pred", F.explode(F.sequence(F.lit(1), "n")).alias("row_id"))


def percent(value):
    return round(value * 100, 2)


def test_five_grades(spark):
    m = M.evaluate(rows(spark, FIVE), []).first()
    assert percent(m["accuracy"]) == 67.98 and percent(m["balanced_accuracy"]) == 53.12
    assert (percent(m["macro_precision"]), percent(m["macro_recall"]), percent(m["macro_f1"])) == (49.27, 53.12, 50.77)
    assert percent(m["weighted_f1"]) == 68.69
    assert [percent(m[f"class_{k}_recall"]) for k in range(5)] == [81.48, 32.99, 58.69, 30.95, 61.51]


def test_two_classes(spark):
    wide = M.confusion_wide(rows(spark, TWO), [], [0, 1])
    c = M.binary_columns(M.cell(1, 1), M.cell(0, 1), M.cell(1, 0), M.cell(0, 0))
    m = wide.select(*[v.alias(k) for k, v in c.items()]).first()
    assert [percent(m[k]) for k in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")] == [79.32, 80.87, 69.70, 93.73, 79.95]
    assert (m["false_negatives"], m["false_positives"]) == (88, 572)


def test_published_split_sizes(spark):
    table = spark.range(15958).select(F.col("id"), (F.col("id") >= 8937).cast("int").alias("label"))
    counts = {(r["split"], r["label"]): r["n"] for r in S.split_report(S.stratified_split(table, ["label"], "id"), "label").collect()}
    assert counts == {("train", 0): 5719, ("train", 1): 4493, ("val", 0): 1430, ("val", 1): 1124, ("test", 0): 1788, ("test", 1): 1404}
    share = {r["label"]: r for r in P.class_distribution(table, "label", [0, 1]).collect()}
    assert round(share[0]["share"], 4) == 0.56 and round(share[0]["max_to_min"], 4) == 1.2729 and not share[0]["is_imbalanced"]


def test_kappa_of_chance_agreement_is_undefined(spark):
    same = spark.createDataFrame([(2, 2), (2, 2)], "y_true int, y_pred int")
    m = M.evaluate(same, []).first()
    assert m["quadratic_kappa"] is None and m["cohen_kappa"] is None and m["accuracy"] == 1.0


def test_preconditions(spark):
    counts = spark.createDataFrame([(0, 10), (1, 1)], "label int, n long")
    with pytest.raises(ValueError, match="fewer than 2"):
        S.require_classes(counts, [0, 1], 2)
    with pytest.raises(ValueError, match="two classes"):
        S.require_classes(counts.filter("label = 0"), [0, 1], 2)
    S.require_classes(counts, [0, 1], 1)
