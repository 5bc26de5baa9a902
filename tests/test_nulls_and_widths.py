"""Rows in = rows out where strata, labels or models are NULL; wide and copied columns; searches."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gradewell.models import training as T
from gradewell.operators import metrics as M
from gradewell.operators import profile as P
from gradewell.operators import splits as S


def gappy(spark, n=1000):
    rows = [(i, None if i % 10 == 0 else i % 3, None if i % 7 == 0 else "m" + str(i % 2), (i * 37 % 101) / 101, i % 5) for i in range(n)]
    return spark.createDataFrame(rows, "row_id int, label int, model string, score double, y_true int")


def test_no_row_is_lost(spark):
    table = gappy(spark)
    for out in (S.stratified_split(table, ["label"], "row_id"), S.stratified_folds(table, ["label", "model"], "row_id", 3), S.with_class_weights(table, "label")):
        assert out.count() == out.select("row_id").distinct().count() == 1000
    assert S.with_class_weights(table, "label").filter("weight is null").count() == 100


def test_null_models_are_groups(spark):
    table = gappy(spark)
    positive = F.col("y_true") >= 2
    groups = {r[0] for r in table.select("model").distinct().collect()}
    for out in (M.auc(table, ["model"], "score", positive), M.threshold_sweep(table, ["model"], "score", positive, [0.5]), M.roc_points(table, ["model"], "score", positive)):
        assert {r["model"] for r in out.collect()} == groups


def test_versions_wider_than_any_limit(spark):
    rng = np.random.default_rng(1)
    names = [f"f{i}" for i in range(420)]
    cells = rng.normal(size=(40, 420))
    cells[:, 418] = cells[:, 419] = cells[:, 0]
    cells[:, 417] = 2 * cells[:, 1]
    table = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(cells)], "row_id int, " + ", ".join(f"{n} double" for n in names))
    out = {r["feature_version"]: r for r in P.version_audit(table, {"all": names, "copies": ["f418", "f419"], "one": ["f418"]}, "row_id").collect()}
    assert (out["all"]["feature_count"], out["all"]["duplicate_features"]) == (420, 2)
    values = table.select(*names).toPandas().to_numpy()
    corr = np.abs(np.corrcoef(values.T))
    assert out["all"]["correlated_pairs"] == int((corr[np.triu_indices(420, 1)] > 0.995).sum()) >= 4
    assert out["copies"]["duplicate_features"] == 1 and out["one"]["duplicate_features"] == 0


def test_dominant_share_is_unknown_below_one_half(spark):
    table = spark.createDataFrame([(float(i % 3), 1.0 if i < 8 else 2.0) for i in range(10)], "a double, b double")
    assert {r["feature"]: r["top_share"] for r in P.dominant_shares(table, ["a", "b"]).collect()} == {"a": None, "b": 0.8}


def test_optimised_cuts_per_group(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(t), float(t + rng.normal() * s)) for g, s in (("x", 0.3), (None, 0.6)) for t in rng.integers(0, 5, 400)]
    table = spark.createDataFrame(rows, "model string, y_true int, value double")
    start, grids = [0.5, 1.5, 2.5, 3.5], [[0.4, 0.6], [1.4, 1.6], [2.4, 2.6], [3.4, 3.6]]
    out = M.optimise_cuts(table, ["model"], "value", "y_true", start, grids, passes=2).collect()
    for group in ("x", None):
        cuts = [r["cut"] for r in sorted(out, key=lambda r: r["position"]) if r["model"] == group]
        t, v = (np.array([r[i] for r in rows if r[0] == group], float) for i in (1, 2))

        def kappa(c):
            p = (v[:, None] > np.array(c)).sum(axis=1)
            return 1 - ((t - p) ** 2).sum() / ((t[:, None] - p) ** 2).mean(axis=1).sum()

        found = next(r["quadratic_kappa"] for r in out if r["model"] == group)
        assert abs(found - kappa(cuts)) < 1e-9 and found >= kappa(start)


def test_random_candidates_and_stacking(spark):
    ranges = {"numTrees": (5, 20), "rate": (0.1, 0.9), "kind": ["a", "b"]}
    drawn = T.random_candidates(ranges, 50)
    assert drawn == T.random_candidates(ranges, 50) and {d["kind"] for d in drawn} == {"a", "b"}
    assert all(5 <= d["numTrees"] <= 20 and 0.1 <= d["rate"] <= 0.9 for d in drawn)
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, float(rng.normal() + 2 * (i % 2)), float(rng.normal())) for i in range(400)]
    table = spark.createDataFrame(rows, "row_id int, label int, a double, b double")
    train, test = table.filter("row_id < 300"), table.filter("row_id >= 300")
    folds = S.stratified_folds(train, ["label"], "row_id", 2)
    model = T.fit_stack(folds, ["a", "b"], ["logistic_regression", "naive_bayes"], "row_id", labels=[0, 1])
    scored = model.predictions(test, "row_id")
    assert scored.count() == 100 and scored.filter("y_true = y_pred").count() >= 75


def test_spearman_with_ties_and_constants(spark):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"a": rng.integers(0, 4, 600), "b": rng.normal(size=600), "flat": 1.0, "zero": rng.choice([0.0, -0.0, 2.0], 600)}).astype(float)
    frame["c"] = frame.a ** 3 - frame.b / 4
    names = list(frame.columns)
    table = spark.createDataFrame(frame)
    found = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in P.correlation_pairs(table, names).collect()}
    ranks = frame.rank()
    expected = {(a, b): abs(np.corrcoef(ranks[a], ranks[b])[0, 1]) for i, a in enumerate(names) for b in names[i + 1:] if "flat" not in (a, b)}
    assert found.keys() == expected.keys() and all(abs(found[k] - v) < 1e-9 for k, v in expected.items())
    assert P.correlation_pairs(table.limit(0), names).count() == 0


def test_constant_columns_have_no_anova_score(spark):
    """Merged over many tasks, the moments of one value round to a spread that is not there."""
    from gradewell.operators import profile
    table = spark.range(0, 200_000, 1, 37).select((F.col("id") % 5).alias("label"), *[F.lit(v).alias(f"c{i}") for i, v in enumerate((1.0, 0.1, 3.7, 1e9 + 0.1))],
                                                 (F.col("id") % 7 + 1e9).alias("x"))
    found = {r["feature"]: r["score"] for r in profile.anova_f(table, ["c0", "c1", "c2", "c3", "x"]).collect()}
    assert [found[f"c{i}"] for i in range(4)] == [None] * 4 and found["x"] is not None
