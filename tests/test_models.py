import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gradewell.models import prep, training as T
from gradewell.operators import metrics as M
from gradewell.operators import profile as P
from gradewell.operators import splits as S
from gradewell.session import materialize


@pytest.fixture(scope="module")
def table(spark):
    """Three features; the first decides the class, the second helps, the third is noise with gaps."""
    rng = np.random.default_rng(0)
    label = rng.integers(0, 3, 600)
    rows = [(i, int(y), float(y + rng.normal(0, 0.3)), float(-y + rng.normal(0, 1.5)), None if i % 7 == 0 else float(rng.normal()))
            for i, y in enumerate(label)]
    return materialize(spark.createDataFrame(rows, "row_id int, label int, a double, b double, c double"))


FEATURES = ["a", "b", "c"]


def test_preparation_matches_numpy(table):
    data = np.array([[np.nan if v is None else v for v in r] for r in table.select(*FEATURES).collect()], dtype=float)
    filled = np.where(np.isnan(data), np.nanmedian(data, axis=0), data)
    p = prep.fit_preparation(table, FEATURES, "standard")
    assert np.allclose([p.centre[f] for f in FEATURES], filled.mean(axis=0)) and np.allclose([p.scale[f] for f in FEATURES], filled.std(axis=0))
    r = prep.fit_preparation(table, FEATURES, "robust")
    spread = np.quantile(filled, 0.75, axis=0) - np.quantile(filled, 0.25, axis=0)
    assert np.allclose([r.scale[f] for f in FEATURES], spread)


def test_out_of_fold_floor_and_partition(table):
    folds = S.stratified_folds(table, ["label"], "row_id", 3)
    oof = T.out_of_fold(folds, FEATURES, "logistic_regression", "row_id", labels=[0, 1, 2])
    T.check_partition(oof, table, "row_id")
    assert M.evaluate(oof, ["model"], [0, 1, 2]).first()["accuracy"] > 0.85
    with pytest.raises(ValueError):
        T.check_partition(oof.filter("row_id > 5"), table, "row_id")


def test_importance_finds_the_deciding_feature(spark, table):
    model = T.fit(table, FEATURES, "random_forest", numTrees=10, maxDepth=4)
    native = {r["feature"]: r["score"] for r in T.native_importance(model, FEATURES, spark).collect()}
    drops = {r["feature"]: r["score"] for r in T.permutation_importance(model, table, FEATURES, "row_id", 1, labels=[0, 1, 2]).collect()}
    assert max(native, key=native.get) == max(drops, key=drops.get) == "a" and drops["a"] > 0.2


def test_shuffle_is_a_permutation(table):
    both = T.shifted(table, "a", "row_id", 1, rows_per_bucket=50)
    got = sorted(r["a_shuffled"] for r in both.collect())
    assert got == sorted(r["a"] for r in table.collect()) and both.filter("a = a_shuffled").count() < 30


def test_calibration_improves_skewed_scores(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 1, 800)
    rows = [(i, float(q ** 3), int(rng.uniform() < q)) for i, q in enumerate(p)]
    scored = materialize(spark.createDataFrame(rows, "row_id int, score double, y int"))
    found = {r["calibration"]: r for r in T.calibration_table(scored.filter("row_id % 2 = 0"), scored.filter("row_id % 2 = 1"), "score", F.col("y") == 1).collect()}
    assert found["isotonic"]["brier"] < found["uncalibrated"]["brier"] and found["sigmoid"]["log_loss"] < found["uncalibrated"]["log_loss"]


def test_saved_models_load_with_metadata(spark, table, tmp_path):
    model = T.fit(table, FEATURES, "kernel_svm", landmarks=16, maxIter=5)
    T.save_model(model, str(tmp_path / "m"), FEATURES, threshold=0.35)
    loaded, metadata = T.load_model(spark, str(tmp_path / "m"))
    assert metadata == {"features": FEATURES, "threshold": 0.35}
    a, b = (T.predictions(m, table, ["row_id"], labels=[0, 1, 2]).orderBy("row_id").collect() for m in (model, loaded))
    assert a == b


def test_fourier_features_approximate_the_kernel(spark, table):
    lifted = prep.RandomFourierFeatures(components=4000, gamma=0.5).transform(
        prep.fit_pca(table, "v", 2)[0].transform(table) if "v" in table.columns else
        table.select("row_id", F.expr("array(a, b)").alias("x")).withColumn("features", __import__("pyspark.ml.functions", fromlist=["x"]).array_to_vector("x")))
    rows = lifted.select("x", vector_to_array("kernel_features").alias("z")).limit(20).collect()
    for left in rows[:5]:
        for right in rows:
            want = np.exp(-0.5 * np.sum((np.array(left["x"]) - np.array(right["x"])) ** 2))
            assert abs(np.dot(left["z"], right["z"]) - want) < 0.12


def test_landmarks_against_an_exact_kernel_machine(spark):
    """Least-squares machines have a closed form: over the whole kernel matrix, and over the features of the landmarks."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 2))
    y = np.where((x ** 2).sum(axis=1) + rng.normal(0, 0.3, 500) > 1.4, 1.0, -1.0)
    rows = materialize(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>").select("i", array_to_vector("x").alias("features")))
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    exact = kernel @ np.linalg.solve(kernel + 5 * np.eye(500), y)
    errors = []
    for landmarks in (40, 500):
        lifted = prep.LandmarkKernel(landmarks=landmarks, gamma=0.5).fit(rows).transform(rows)
        seen = np.array([r["z"] for r in lifted.orderBy("i").select(vector_to_array("kernel_features").alias("z")).collect()])
        value = seen @ np.linalg.solve(seen.T @ seen + 5 * np.eye(seen.shape[1]), seen.T @ y)
        errors.append((np.abs(seen @ seen.T - kernel).max(), np.abs(value - exact).max()))
    assert errors[0][1] < 0.15 and max(errors[1]) < 1e-4  # a row far from 40 landmarks may still miss its own kernel value


def test_landmarks_ignore_copies(spark):
    rows = spark.createDataFrame([([1.0, 2.0],)] * 500 + [([float(i), 0.0],) for i in range(9)], "x array<double>").select(array_to_vector("x").alias("features"))
    model = prep.LandmarkKernel(landmarks=256).fit(rows.repartition(3))
    assert model.getOrDefault("count") == 10 and model.getOrDefault("gamma") == 0.5
    with pytest.raises(ValueError):
        prep.LandmarkKernel().fit(rows.limit(0))


def test_search_resumes(table):
    folds = S.stratified_folds(table, ["label"], "row_id", 2)
    grid = [{"maxIter": 2}, {"maxIter": 5}]
    first = T.search(folds, FEATURES, "logistic_regression", grid[:1], "row_id", labels=[0, 1, 2])
    both = T.search(folds, FEATURES, "logistic_regression", grid, "row_id", done=first, labels=[0, 1, 2])
    assert sorted(r["trial"] for r in both.collect()) == [0, 1]
    want = M.evaluate(T.out_of_fold(folds, FEATURES, "logistic_regression", "row_id", labels=[0, 1, 2], maxIter=2), ["model"], [0, 1, 2]).first()
    got = both.filter("trial = 0").first()
    assert abs(got["value"] - want["macro_f1"]) < 1e-9 and abs(got["macro_recall"] - want["macro_recall"]) < 1e-9


def test_killed_search_goes_on_from_its_log(table, tmp_path, monkeypatch):
    folds = materialize(S.stratified_folds(table, ["label"], "row_id", 2))
    grid = [{"numTrees": 4, "maxDepth": d} for d in (4, 3, 1, 5)]
    path, plain, started = str(tmp_path / "log"), T.fold_models, []

    def counted(*args):
        def wrap(f, predict):
            def run(params):
                started.append((f, params["maxDepth"]))
                if params["maxDepth"] == 5 and len(started) < 7:
                    raise KeyboardInterrupt
                return predict(params)
            return run
        return {f: wrap(f, p) for f, p in plain(*args).items()}

    monkeypatch.setattr(T, "fold_models", counted)
    with pytest.raises(KeyboardInterrupt):
        T.search(folds, FEATURES, "random_forest", grid, "row_id", labels=[0, 1, 2], log_path=path, parallel=1, startup=2)
    before = list(started)
    log = T.search(folds, FEATURES, "random_forest", grid, "row_id", labels=[0, 1, 2], log_path=path, parallel=2, startup=2).collect()
    assert [r["trial"] for r in log] == [0, 1, 2, 3] and {d for _, d in started[len(before):]} == {5}
    assert log[2]["state"] == "PRUNED" and log[2]["value"] == log[2]["first_fold"] < max(log[0]["first_fold"], log[1]["first_fold"])
    again = len(started)
    assert T.search(folds, FEATURES, "random_forest", grid, "row_id", labels=[0, 1, 2], log_path=path).count() == 4 and len(started) == again


def test_duplicate_columns_and_version_audit(fx):
    copies = P.duplicate_columns(fx.feats.withColumn("copy", F.col("total")), ["total", "copy", "qty_sum"], "row_id")
    assert [tuple(r) for r in copies.collect()] == [("copy", "total")]
