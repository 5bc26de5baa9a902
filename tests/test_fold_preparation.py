"""Preparation of all folds from counts per fold, against one preparation per fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.models import prep, training as T

FEATURES = ["a", "b", "none", "const"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, int(rng.integers(0, 3)), float(rng.normal()) if i % 4 else None, float(rng.integers(0, 3)) if i % 3 else float("inf"), None, 0.1) for i in range(400)]
    return spark.createDataFrame(rows, "row_id int, fold int, label int, a double, b double, none double, const double")


@pytest.mark.parametrize("scaler", ["standard", "robust", "none"])
def test_equals_a_preparation_per_fold(table, scaler):
    found = prep.fit_preparations(table, FEATURES, [scaler], "fold", [0, 1, 2], [0, 1, 2, None])
    for f in (0, 1, 2, None):
        want, got = prep.fit_preparation(table.filter(F.col("fold") != f) if f is not None else table, FEATURES, scaler), found[(scaler, f)]
        assert got.fill == want.fill
        for name in FEATURES:
            assert got.centre[name] == pytest.approx(want.centre[name], rel=1e-12, abs=1e-15)
            if name != "const":
                assert got.scale[name] == pytest.approx(want.scale[name], rel=1e-12)
        assert got.scale["const"] == 1.0


def test_models_equal_fits_per_fold(table):
    models = T.fold_fits(table, FEATURES[:2], ["naive_bayes"], "row_id", whole=True)
    for f in (0, 1, 2, None):
        want = T.fit(table.filter(F.col("fold") != f) if f is not None else table, FEATURES[:2], "naive_bayes", key="row_id").stages[-1]
        got = models[("naive_bayes", f)].stages[-1]
        assert np.allclose(got.theta.toArray(), want.theta.toArray(), rtol=1e-9, atol=1e-12) and np.allclose(got.pi.toArray(), want.pi.toArray())


def test_passes_do_not_grow_with_folds(spark, table):
    """Before, every fold and model prepared anew, in a dozen jobs each."""
    group = "fold-preparation"
    spark.sparkContext.setJobGroup(group, "")
    prep.fit_preparations(table, FEATURES, ["standard"], "fold", [0, 1, 2], [0, 1, 2, None])
    several = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup(group + "-one", "")
    prep.fit_preparation(table, FEATURES, "standard")
    one = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group + "-one"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert several <= one + 2


def test_grid_prepares_once(fx, monkeypatch):
    """m03 before prepared every fold of every combination anew."""
    from gradewell.plans import modelling as P

    asked = []
    monkeypatch.setattr(P.prep, "fit_preparations", lambda df, features, scalers, *a: asked.append((len(features), scalers)) or {})
    monkeypatch.setattr(P.T, "fit_preparations", lambda *a: asked.append("again"))
    monkeypatch.setattr(P.T, "fold_fits", lambda *a, **k: {})
    monkeypatch.setattr(P.T, "held_predictions", lambda df, *a: df.selectExpr("label as y_true", "label as y_pred"))
    P.pipeline_grid(fx)
    assert asked == [(7, ["standard", "robust"])]


def test_stack_inputs_are_out_of_fold_without_a_shuffle(table, monkeypatch):
    """Every row's inputs are the probabilities of the models that have not seen it; before, they met by a shuffle of all rows and models."""
    plans = []
    monkeypatch.setattr(T, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    models = T.fold_fits(table, FEATURES[:2], ["naive_bayes", "logistic_regression"], "row_id")
    _, meta = T.stack(table, FEATURES[:2], ["naive_bayes", "logistic_regression"], "row_id", labels=[0, 1, 2], models=models)
    assert plans and all("Exchange" not in p for p in plans)
    got = {r["row_id"]: r["features"].toArray() for r in meta.collect()}
    for i, name in enumerate(("naive_bayes", "logistic_regression")):
        for r in T.held_predictions(table, models, name, "row_id", labels=[0, 1, 2]).collect():
            assert np.allclose(got[r["row_id"]][3 * i:3 * i + 3], r["prob"])
    assert len(got) == 400


def test_partitions_of_a_fit_grow_with_its_rows(spark, table, monkeypatch):
    """Before, a fit read its features in as many partitions as the table has, whatever their size."""
    seen = []

    class Stop(Exception):
        pass

    def fit(self, rows):
        seen.append([len(p) for p in rows.rdd.glom().collect()])
        raise Stop

    monkeypatch.setattr(T.Pipeline, "fit", fit)
    monkeypatch.setattr(T, "TASK_BYTES", 16 * 8 * 10)
    with pytest.raises(Stop):
        T.fit(table.coalesce(1), FEATURES[:2], "kernel_svm", landmarks=16)
    assert sum(seen[0]) == 400 and len(seen[0]) == 40 and max(seen[0]) <= 20
