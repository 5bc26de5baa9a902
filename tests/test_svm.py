"""Kernel machines over landmarks against Spark ML's linear machine over the lifted rows."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gradewell.models import prep, svm
from gradewell.models import training as T
from gradewell.session import materialize


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2))
    r = (x ** 2).sum(axis=1) + rng.normal(0, 0.4, 600)
    data = [(i, v.tolist(), float(int(q > 1) + int(q > 2.5)), float(rng.uniform(0.5, 2))) for i, (v, q) in enumerate(zip(x, r))]
    return materialize(spark.createDataFrame(data, "i int, x array<double>, grade double, weight double").withColumn("features", array_to_vector("x")).repartition(3))


@pytest.mark.parametrize("classes", [2, 3])
def test_the_objective_is_that_of_the_linear_machine_over_lifted_rows(rows, classes):
    known = rows.withColumn("label", F.col("grade") if classes == 3 else (F.col("grade") > 0).cast("double"))
    kernel = prep.LandmarkKernel(landmarks=60).fit(known)
    lifted = kernel.transform(known).withColumn("z", vector_to_array("kernel_features"))
    held = lifted.orderBy("i").collect()
    z, weight = np.array([r["z"] for r in held]), np.array([r["weight"] for r in held])
    signs = svm.targets(np.array([r["label"] for r in held]), classes)
    model = svm.LandmarkSVC(landmarks=60, classes=classes).fit(known)
    got = np.array([r["decision"] for r in model.transform(known).orderBy("i").collect()])
    projection = np.array(kernel.getOrDefault("projection")).reshape(60, -1)
    w = np.linalg.lstsq(projection, np.array(model.getOrDefault("dual")).reshape(60, -1), rcond=None)[0]
    for m in range(signs.shape[1]):
        own = lifted.withColumn("label", (F.col("label") == (m if classes == 3 else 1)).cast("double"))
        spark_ml = LinearSVC(featuresCol="kernel_features", weightCol="weight", maxIter=100, regParam=0.001, standardization=False).fit(own)
        theirs = spark_ml.coefficients.toArray()
        ours, reached = ((weight @ np.maximum(0, 1 - signs[:, m] * d)) / weight.sum() + 0.0005 * (v @ v)
                         for d, v in ((got[:, m], w[:, m]), (z @ theirs + spark_ml.intercept, theirs)))
        assert ours <= reached * 1.001
        assert np.mean((got[:, m] > 0) == (z @ theirs + spark_ml.intercept > 0)) > 0.98
    best = [r["prediction"] for r in model.transform(known).orderBy("i").collect()]
    assert best == list(got.argmax(axis=1) if classes == 3 else got[:, 0] > 0)


def test_lifted_rows_are_not_kept(rows, monkeypatch):
    """Before, the fit kept every row's 256 lifted features, some thirty times the row itself."""
    kept, blocks = [], svm.blocks

    def watched(known, width):
        kept.append((width, blocks(known, width)))
        return kept[0][1]

    monkeypatch.setattr(svm, "blocks", watched)
    table = rows.selectExpr("i", "x[0] as a", "x[1] as b", "int(grade > 0) as label")
    model = T.fit(table, ["a", "b"], "kernel_svm", landmarks=50)
    assert isinstance(model, PipelineModel) and "kernel_features" not in model.transform(table).columns
    assert [width for width, _ in kept] == [2] and {x.shape[1] for _, _, x in kept[0][1].collect()} == {3}
    assert not kept[0][1].is_cached
    hits = T.predictions(model, table, ["i"]).filter("y_true = y_pred").count()
    assert hits > 500


def test_rows_without_a_label_and_constant_rows(rows):
    table = rows.selectExpr("i", "1.0D as a", "case when i % 5 > 0 then int(i % 5 > 2) end as label")
    model = T.fit(table, ["a"], "kernel_svm", landmarks=8)
    assert {r["y_pred"] for r in T.predictions(model, table, ["i"]).collect()} <= {0, 1}
