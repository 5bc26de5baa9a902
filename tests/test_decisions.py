import pytest
from pyspark.sql import functions as F

from gradewell.functions import decisions as D
from gradewell.functions import labels as LB


def one(spark, columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("positive,grade,status,result", [
    (True, 2, "aligned", "referable"), (False, 1, "aligned", "non_referable"),
    (False, 3, "severity_escalation", "referable_review"), (True, 0, "screening_severity_disagreement", "referable_review"),
])
def test_reconciliation(spark, positive, grade, status, result):
    row = one(spark, D.reconcile(F.lit(positive), F.lit(grade)))
    assert (row["status"], row["result"]) == (status, result)
    assert row["positive"] == (result != "non_referable")


@pytest.mark.parametrize("quality_ok,available", [(False, True), (True, False)])
def test_rows_not_assessed_have_no_probability(spark, quality_ok, available):
    row = one(spark, D.screening_result(F.lit(quality_ok), F.lit(available), F.lit(True), F.lit(True), F.lit(0.9)))
    assert row["result"] == "uncertain" and row["positive_probability"] is None and row["confidence"] is None


def test_labels_outside_the_domain_raise(spark):
    with pytest.raises(Exception, match="outside the domain"):
        spark.range(1).select(LB.binary_label(F.lit(7))).collect()


def test_half_even_rounding(spark):
    row = one(spark, {"a": D.grade_score(F.lit(1), F.lit(0.125)), "none": D.grade_score(F.lit(0), F.lit(9.0))})
    assert row["a"] == 25.2 and row["none"] == 0.0
