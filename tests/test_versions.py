"""The catalogue of feature versions and the grid over it."""

from pyspark.sql import functions as F

from gradewell.models import training as T
from gradewell.models import versions as V
from gradewell.operators import metrics as M

BASE = ["a", "b", "c"]
SAID = ["cnn_x__entropy", "cnn_x__prob_class_0", "cnn_y_2__max_probability", "cnn_y_2__referable_probability"]
EMBEDDED = ["cnn_embed_x_0", "cnn_embed_x_1", "cnn_embed_y_2_0", "cnn_embed_y_2_1"]


def test_catalogue():
    found = V.build_versions(["id", *BASE, *SAID, *EMBEDDED], [*BASE, "absent"], ["c", "absent"], "y_2", first=2, narrow=1)
    assert [n.split("_")[0] for n in found] == [f"v{i}" for i in range(1, 15)]
    by = {n.split("_")[0]: c for n, c in found.items()}
    best, deep = SAID[2:], EMBEDDED[2:]
    assert by["v1"] == BASE + best and by["v2"] == BASE + deep[:1] and by["v5"] == BASE + best + deep
    assert by["v7"] == ["c"] + best + deep and by["v8"] == ["a", "b"] + best + deep
    assert by["v10"] == BASE + SAID + ["cnn_embed_x_0", "cnn_embed_y_2_0"] and by["v12"] == by["v10"][3:]
    assert by["v13"] == BASE + [SAID[0], SAID[2]] and by["v14"] == BASE + [SAID[1], SAID[3]] and by["v11"] == BASE
    assert V.build_versions(BASE, BASE, [])["v12_networks_only"] == []
    assert V.build_versions([*BASE, *SAID], BASE, [])["v1_base_best_predictions"] == BASE + SAID


def test_grid_equals_single_fits(spark, fx):
    rows = fx.feats_once.withColumn("label", F.when(F.col("row_id") % 50 != 0, F.col("label")))
    train, val, test = (rows.filter(F.col("row_id") % 3 == i) for i in range(3))
    versions = {"quantities": ["n_lines", "qty_sum"], "all": ["disc_max", "total", "qty_sum", "n_lines"], "none": []}
    models = {"naive_bayes": {}, "extra_trees": {"numTrees": 5, "maxDepth": 4}}
    table = V.version_grid(train, val, test, versions, models, "row_id")
    found = {(r["model"], r["feature_version"]): r for r in table.collect()}
    assert len(found) == 6 and sorted(r["rank"] for r in found.values() if r["rank"]) == [1, 2, 3, 4]
    for name in models:
        failed = found[name, "none"]
        assert (failed["status"], failed["rank"], failed["val_macro_f1"], failed["error"]) == ("failed", None, None, "no columns")
    for version in ("quantities", "all"):
        model = T.fit(train.filter("label is not null"), versions[version], "naive_bayes")
        for part, column in ((val, "val_macro_f1"), (test, "macro_f1")):
            scored = T.predictions(model, part.filter("label is not null"), ["row_id"]).withColumn("model", F.lit("m"))
            assert abs(M.evaluate(scored, ["model"]).first()["macro_f1"] - found["naive_bayes", version][column]) < 1e-9
    best = min((r for r in found.values() if r["rank"]), key=lambda r: r["rank"])
    assert best["val_macro_f1"] == max(r["val_macro_f1"] for r in found.values() if r["rank"])
    assert found["extra_trees", "all"]["feature_count"] == 4


def test_bayes_of_all_versions_equals_a_fit_per_version(spark):
    """Before, every version read all training and held rows again for itself."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows = [(float(i % 3), [float(v) for v in rng.normal(i % 3, 1 + np.arange(4))], 1.0 + i % 2, "val" if i % 2 else "test") for i in range(300)]
    df = spark.createDataFrame(rows, "label double, x array<double>, weight double, _part string")
    from pyspark.ml.functions import array_to_vector
    df = df.withColumn("_all", array_to_vector("x"))
    versions = {"one": ["a"], "some": ["d", "b"], "all": ["a", "b", "c", "d"], "none": []}
    got = V.bayes_counts(df, df, ["a", "b", "c", "d"], versions)
    scored = V.sliced(df, df, ["a", "b", "c", "d"])
    for name in ("one", "some", "all"):
        want = scored("naive_bayes", versions[name]).groupBy("_part", "y_true", "y_pred").count().collect()
        assert {(r["_part"], r["y_true"], r["y_pred"], r["count"]) for r in got[name]} == {tuple(r) for r in want}
    assert "none" not in got


def test_logistic_regressions_of_all_versions_are_fitted_at_once(spark, monkeypatch):
    """Before, every version read and cached all training rows for itself, and every step of it was a job of its own."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(11)
    label = rng.integers(0, 3, 400)
    rows = [(float(y), [float(v) for v in rng.normal(0, 1, 4) * [1, 3, 1, 0] + [y, 0, -2 * (y == 1), 5]], float(1 + y / 2), "val" if i % 2 else "test") for i, y in enumerate(label)]
    df = spark.createDataFrame(rows, "label double, x array<double>, weight double, _part string").withColumn("_all", array_to_vector("x")).repartition(3).cache()
    columns, versions = ["a", "b", "c", "d"], {"one": ["a"], "some": ["d", "b", "c"], "all": ["a", "b", "c", "d"], "none": []}
    places = {v: [columns.index(c) for c in names] for v, names in versions.items() if names}
    models = V.logistic.fit_slices(df, 4, 3, places, maxIter=100)
    x = np.array([r[1] for r in rows])
    for v, at in places.items():
        cut = V.VectorSlicer(inputCol="_all", outputCol="features", indices=at)
        spark_model = V.Pipeline(stages=[cut, V.estimator("logistic_regression", 3, maxIter=1000, tol=1e-12)[0]]).fit(df).stages[-1]
        want = x[:, at] @ spark_model.coefficientMatrix.toArray().T + spark_model.interceptVector.toArray()
        got = x @ models[v][1:] + models[v][0]
        assert np.abs((want - want.mean(axis=1, keepdims=True)) - (got - got.mean(axis=1, keepdims=True))).max() < 1e-3
    held = df.select("label", "_all", "weight", "_part")
    counts = V.logistic_counts(held, held, columns, versions, 3)
    assert set(counts) == {"one", "some", "all"} and all(sum(r["count"] for r in rs) == 400 for rs in counts.values())
    train, parts = spark.createDataFrame([(i, int(r[0]), *r[1]) for i, r in enumerate(rows)], "row_id int, label int, a double, b double, c double, d double"), []
    monkeypatch.setattr(V, "sliced", lambda *a: parts.append)  # called for no version
    grid = V.version_grid(train, train, train, versions, {"logistic_regression": {"maxIter": 5000}}, "row_id").collect()
    assert not parts and sorted(r["status"] for r in grid) == ["failed", "ok", "ok", "ok"]
    assert max(r["macro_f1"] for r in grid if r["macro_f1"]) > .4  # of five grades three occur
