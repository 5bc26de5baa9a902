"""Estimators, cross-validated training, calibration, importance, scoring and persistence."""

from __future__ import annotations

import json
import random
import threading
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.functions.labels import grade_name
from gradewell.functions.probability import first_argmax
from gradewell.models import forests
from gradewell.models.boosting import BoosterModel, fit_booster
from gradewell.models.forests import ForestModel
from gradewell.models.prep import LandmarkKernelModel, Preparation, RandomFourierFeatures, fit_preparation, fit_preparations
from gradewell.models.svm import LandmarkSVC
from gradewell.operators import metrics as M
from gradewell.operators.ordering import hash_order
from gradewell.operators.splits import with_class_weights
from gradewell.session import materialize

MODEL_NAMES = ["logistic_regression", "random_forest", "extra_trees", "balanced_forest", "boosted_trees", "naive_bayes",
               "linear_svm", "kernel_svm"]
#: Models of binned rows, which need no pipeline.
TREES = (*forests.KINDS, "boosted_trees")
#: Feature bytes that one task holds in an iterative fit.
TASK_BYTES = 128 << 20


def estimator(name: str, classes: int, seed: int = K.SEED, **params) -> list[Estimator]:
    """Stages of a named classifier on ``features``, ``label`` and ``weight``.

    Forests are in :mod:`gradewell.models.forests`; :func:`fit` boosts by :mod:`gradewell.models.boosting`, this is Spark ML's form as a
    stage. Boosting with more than two classes, and linear SVMs, are one-vs-rest here. The kernel SVM (:mod:`gradewell.models.svm`) is a linear one over features of a kernel seen through landmarks.
    """
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    if name == "logistic_regression":
        return [LogisticRegression(**common, **{"maxIter": 50, "regParam": 0.01, **params})]
    if name == "boosted_trees":
        boosted = GBTClassifier(**common, seed=seed, **{"maxIter": 20, "maxDepth": 4, **params})
        return [boosted] if classes == 2 else [OneVsRest(classifier=boosted, labelCol="label", featuresCol="features", weightCol="weight")]
    if name == "naive_bayes":
        return [NaiveBayes(**common, modelType="gaussian", **params)]
    if name == "linear_svm":
        svm = LinearSVC(**common, **{"maxIter": 30, "regParam": 0.01, **params})
        return [svm] if classes == 2 else [OneVsRest(classifier=svm, labelCol="label", featuresCol="features", weightCol="weight")]
    if name == "kernel_svm":
        return [LandmarkSVC(classes=classes, **params)]
    raise ValueError(f"unknown model {name}")


def forest_params(params: Mapping) -> dict:
    """Parameters of :func:`forests.grow_forest` from the names that the other tree models use."""
    names = {"numTrees": "n_trees", "maxDepth": "max_depth", "minInstancesPerNode": "min_leaf", "featureSubsetStrategy": "strategy"}
    return {names.get(k, k): v for k, v in params.items()}


def booster_params(params: Mapping, n_features: int) -> dict:
    """Parameters of :func:`boosting.fit_booster` from Spark ML's names, with its defaults."""
    names = {"maxIter": "rounds", "maxDepth": "depth", "stepSize": "rate", "subsamplingRate": "share"}
    strategy = str(params.get("featureSubsetStrategy", "all"))
    share = float(strategy) if "." in strategy else forests.features_tried(strategy, n_features) / n_features
    given = {names.get(k, k): v for k, v in params.items() if k != "featureSubsetStrategy"}
    return {"rounds": 20, "depth": 4, "rate": 0.1, "share": 1.0, "feature_share": share, **given}


def fit(train: DataFrame, features: Sequence[str], name: str, label: str = "label", scaler: str = "standard", key: str | None = None,
        preparation: Preparation | None = None, **params) -> PipelineModel | ForestModel | BoosterModel:
    """Impute, scale, weigh classes and fit; everything is fitted on ``train`` only.

    Forests and boosters draw rows by a hash of ``key`` (without it, of features and label) and need no scaling. ``preparation`` is that
    of these rows, if it is known: it does not depend on the label.
    """
    drawn_by = [key] if key else [*features, label]
    if name in forests.KINDS:
        return forests.fit_forest(train, features, name, drawn_by, label, **forest_params(params))
    if name == "boosted_trees":
        return fit_booster(train, features, drawn_by, label, **booster_params(params, len(features)))
    preparation = preparation or fit_preparation(train, features, scaler)
    rows = with_class_weights(train.withColumn("label", F.col(label).cast("double")), "label")
    classes, n = rows.agg((F.max("label") + 1).cast("int"), F.count(F.lit(1))).first()
    rows = spread(rows.select(*features, "label", "weight"), n, params.get("landmarks", 256) if name == "kernel_svm" else len(features))
    return Pipeline(stages=[*preparation.stage(), *estimator(name, classes, **params)]).fit(rows)


def spread(rows: DataFrame, n: int, width: int) -> DataFrame:
    """``rows`` over so many partitions that the cached features of none, ``width`` numbers a row, pass ``TASK_BYTES``.

    A fit keeps the partitions it is given, and every iteration reads them; their number must grow with the rows.
    """
    needed = -(-n * width * 8 // TASK_BYTES)
    return rows.repartition(max(needed, rows.sparkSession.sparkContext.defaultParallelism)) if needed > 1 else rows


def predictions(model: PipelineModel | ForestModel | BoosterModel, rows: DataFrame, keep: Sequence[str], truth: str | None = "label",
                labels: Sequence[int] = K.GRADES) -> DataFrame:
    """Prediction table: kept columns, y_true, y_pred and, where the model has them, probabilities.

    Classes the model does not know have probability 0.
    """
    if isinstance(model, (ForestModel, BoosterModel)):
        return model.predictions(rows, keep, truth, labels)
    out = model.transform(rows)
    columns = [F.col(c) for c in keep]
    if truth:
        columns.append(F.col(truth).cast("int").alias("y_true"))
    columns.append(F.col("prediction").cast("int").alias("y_pred"))
    if "probability" in out.columns:
        known = vector_to_array("probability")
        prob = F.array(*[F.coalesce(F.try_element_at(known, F.lit(i + 1)), F.lit(0.0)) for i in range(len(labels))])
        columns.append(prob.alias("prob"))
    return out.select(*columns)


def parted_counts(df: DataFrame, fold: str, label: str) -> dict[tuple, int]:
    """Rows per (fold, label), rows without a fold left out."""
    return {(r[0], r[1]): r["count"] for r in df.filter(F.col(fold).isNotNull()).groupBy(F.col(fold), F.col(label).cast("double")).count().collect()}


def fold_fits(df: DataFrame, features: Sequence[str], names: Sequence[str], key: str, fold: str = "fold", label: str = "label", scaler: str = "standard",
              whole: bool = False, preparations: Mapping | None = None, parallel: int = 4, **params) -> dict[tuple, PipelineModel | ForestModel]:
    """Models by (name, fold), fitted as by :func:`fit` on the rows outside the fold; with ``whole`` also by (name, None), on all rows.

    Preparation and class weights of all folds come from counts per fold (``preparations`` may bring the former, by (scaler, fold)),
    so a fold costs its fits and no further pass. ``parallel`` fits run side by side.
    """
    counts = parted_counts(df, fold, label)
    folds = sorted({f for f, _ in counts})
    left_out = [*folds, *([None] if whole else [])]
    if preparations is None and any(n not in TREES for n in names):
        preparations = fit_preparations(df, features, [scaler], fold, folds, left_out)
    features = list(features)

    def one(at: tuple) -> PipelineModel | ForestModel:
        name, f = at
        train = df.filter(F.col(fold) != f) if f is not None else df.filter(F.col(fold).isNotNull())
        if name in TREES:
            return fit(train, features, name, label, key=key, **params)
        sizes = Counter()
        for (p, c), n in counts.items():
            if p != f and c is not None:
                sizes[c] += n
        total = sum(sizes.values())
        weights = F.create_map(*[F.lit(v) for c, n in sizes.items() for v in (float(c), total / (len(sizes) * n))])
        rows = train.withColumn("label", F.col(label).cast("double")).withColumn("weight", F.try_element_at(weights, F.col("label")))
        return Pipeline(stages=[*preparations[(scaler, f)].only(features).stage(), *estimator(name, int(max(sizes)) + 1, **params)]).fit(rows)

    ats = [(name, f) for f in left_out for name in names]
    with ThreadPoolExecutor(parallel) as pool:
        return dict(zip(ats, pool.map(inheritable_thread_target(df.sparkSession)(one), ats)))


def held_predictions(df: DataFrame, models: Mapping[tuple, PipelineModel | ForestModel], name: str, key: str, fold: str = "fold", label: str = "label",
                     labels: Sequence[int] = K.GRADES) -> DataFrame:
    """Predictions of every row by the model, as of :func:`fold_fits`, of the folds it is not part of."""
    parts = [predictions(model, df.filter(F.col(fold) == f), [key, fold], label, labels) for (n, f), model in models.items() if n == name and f is not None]
    return reduce(DataFrame.unionByName, parts).withColumn("model", F.lit(name))


def out_of_fold(df: DataFrame, features: Sequence[str], name: str, key: str, fold: str = "fold", label: str = "label",
                labels: Sequence[int] = K.GRADES, **params) -> DataFrame:
    """Predictions of every row by the model of the folds it is not part of."""
    return held_predictions(df, fold_fits(df, features, [name], key, fold, label, **params), name, key, fold, label, labels)


def check_partition(oof: DataFrame, df: DataFrame, key: str) -> None:
    """Raise unless every row of ``df`` has exactly one out-of-fold prediction."""
    stats = oof.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("keys"), F.max("n").alias("most")).first()
    if stats["most"] != 1 or stats["keys"] != df.count():
        raise ValueError(f"out-of-fold rows do not match the table: {stats['keys']} keys, at most {stats['most']} per key")


def cross_validate(df: DataFrame, features: Sequence[str], names: Sequence[str], key: str, label: str = "label",
                   labels: Sequence[int] = K.GRADES, **params) -> DataFrame:
    """Metrics per model and fold from the stitched predictions of all models, in one job."""
    models = fold_fits(df, features, names, key, label=label, **params)
    parts = [held_predictions(df, models, name, key, label=label, labels=labels).select(key, "model", "fold", "y_true", "y_pred") for name in names]
    return M.evaluate(reduce(DataFrame.unionByName, parts), ["model", "fold"], labels)


def random_candidates(ranges: Mapping[str, Sequence], trials: int, seed: int = K.SEED) -> list[dict]:
    """Parameter sets drawn at random, always the same ones for a seed: from a list of choices, or from a (low, high) tuple,
    whole numbers where both ends are whole."""
    draw = random.Random(seed)

    def pick(values: Sequence):
        if not isinstance(values, tuple):
            return draw.choice(list(values))
        low, high = values
        return draw.randint(low, high) if isinstance(low, int) and isinstance(high, int) else draw.uniform(low, high)

    return [{name: pick(values) for name, values in ranges.items()} for _ in range(trials)]


TRIAL = "trial int, model string, state string, value double, macro_recall double, params string, first_fold double"


class TrialLog:
    """Finished trials of a search; with a path, every trial is appended to a Parquet folder as soon as it ends."""

    def __init__(self, spark: SparkSession, path: str | None, done: DataFrame | None, model: str) -> None:
        self.spark, self.path, self.lock = spark, path, threading.Lock()
        self.rows: dict[int, tuple] = {}
        for known in (done, self.stored()):
            if known is not None:
                for r in known.filter((F.col("model") == model) & F.col("state").isin("COMPLETE", "PRUNED")).collect():
                    self.rows[r["trial"]] = tuple(r[c.split()[0]] for c in TRIAL.split(", "))

    def stored(self) -> DataFrame | None:
        if not self.path:
            return None
        try:
            return self.spark.read.schema(TRIAL).parquet(self.path)
        except AnalysisException as error:  # nothing is written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    def add(self, row: tuple) -> None:
        with self.lock:
            self.rows[row[0]] = row
            if self.path:
                self.spark.createDataFrame([row], TRIAL).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([self.rows[t] for t in sorted(self.rows)], TRIAL)


def fold_models(df: DataFrame, features: Sequence[str], name: str, key: str, fold: str, label: str, labels: Sequence[int]) -> dict:
    """Per fold a function of parameters that fits on the other folds and predicts this one; forests share the binned rows."""
    def one(f) -> Callable[[Mapping], DataFrame]:
        rest, held = df.filter(F.col(fold) != f), df.filter(F.col(fold) == f)
        if name not in forests.KINDS:
            return lambda params: predictions(fit(rest, features, name, label, key=key, **params), held, [key], label, labels)
        rows = forests.prepare(rest, features, [key], label, max_bins=32)
        binned = materialize(rows.bins.apply(held.withColumn("y_true", F.col(label).cast("int")), [key, "y_true"]))
        return lambda params: forests.grow_forest(rows, name, **forest_params(params)).votes(binned, [key, "y_true"]).withColumn("y_pred", first_argmax("prob"))

    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    with ThreadPoolExecutor(len(folds)) as pool:
        return dict(zip(folds, pool.map(inheritable_thread_target(df.sparkSession)(one), folds)))


def confusion(scored: DataFrame) -> Counter:
    """Rows per (y_true, y_pred): at most classes squared numbers."""
    return Counter({(r["y_true"], r["y_pred"]): r["count"] for r in scored.groupBy("y_true", "y_pred").count().collect()})


def macro_scores(counts: Counter, labels: Sequence[int]) -> tuple[float, float]:
    """Macro F1 and macro recall over ``labels`` from a confusion table; a label without rows counts 0."""
    hit = [counts[(c, c)] for c in labels]
    true = [sum(n for (t, _), n in counts.items() if t == c) for c in labels]
    said = [sum(n for (_, p), n in counts.items() if p == c) for c in labels]
    f1 = [2 * h / (t + p) if t + p else 0.0 for h, t, p in zip(hit, true, said)]
    return sum(f1) / len(labels), sum(h / t if t else 0.0 for h, t in zip(hit, true)) / len(labels)


def search(df: DataFrame, features: Sequence[str], name: str, candidates: Sequence[Mapping], key: str, label: str = "label",
           done: DataFrame | None = None, labels: Sequence[int] = K.GRADES, log_path: str | None = None, parallel: int = 4, startup: int = 5, fold: str = "fold") -> DataFrame:
    """Trial log of a parameter search: one row per candidate with its out-of-fold macro F1.

    ``parallel`` trials run side by side, each in its own scheduler pool. The first ``startup`` candidates run over all folds. A later one
    whose first fold stays below the best first fold of theirs is stopped there: state PRUNED, its value is that fold's. So what is
    stopped does not depend on which trial ends first. Candidates that ``done`` or the log at ``log_path`` list as COMPLETE or
    PRUNED are not run again; a search that was killed goes on with the open ones.
    """
    spark = df.sparkSession
    log = TrialLog(spark, log_path, done, name)
    if all(t in log.rows for t in range(len(candidates))):
        return log.table()
    models = fold_models(df, features, name, key, fold, label, labels)
    first, *others = models

    def run(trial: int, bar: float | None) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{trial % parallel}")
        params = candidates[trial]
        counts = confusion(models[first](params))
        start = macro_scores(counts, labels)[0]
        text = json.dumps(dict(params), sort_keys=True)
        if bar is not None and start < bar:
            log.add((trial, name, "PRUNED", start, None, text, start))
            return
        for f in others:
            counts += confusion(models[f](params))
        log.add((trial, name, "COMPLETE", *macro_scores(counts, labels), text, start))

    def run_all(trials: Sequence[int], bar: float | None) -> None:
        open_trials = [t for t in trials if t not in log.rows]
        with ThreadPoolExecutor(parallel) as pool:
            for running in [pool.submit(inheritable_thread_target(spark)(run), t, bar) for t in open_trials]:
                running.result()

    head = range(min(startup, len(candidates)))
    run_all(head, None)
    known = [log.rows[t][6] for t in head if log.rows[t][6] is not None]
    run_all(range(len(head), len(candidates)), max(known) if known else None)
    return log.table()


def stacked(rows: DataFrame, base: Sequence[PipelineModel | ForestModel], labels: Sequence[int]) -> DataFrame:
    """``rows`` with ``_p0``, ``_p1``, ...: the probabilities of each base model, in one pass."""
    out = rows
    for i, model in enumerate(base):
        if isinstance(model, (ForestModel, BoosterModel)):
            scored = model.predictions(out, out.columns, None, labels)
            out = scored.select(*out.columns, F.col("prob").alias(f"_p{i}"))
            continue
        known = vector_to_array("probability")
        prob = F.array(*[F.coalesce(F.try_element_at(known, F.lit(n + 1)), F.lit(0.0)) for n in range(len(labels))])
        out = model.transform(out).select(*out.columns, prob.alias(f"_p{i}"))
    return out


def stack(df: DataFrame, features: Sequence[str], names: Sequence[str], key: str, label: str = "label",
          labels: Sequence[int] = K.GRADES, fold: str = "fold", models: Mapping[tuple, PipelineModel | ForestModel] | None = None, **params) -> tuple[PipelineModel, DataFrame]:
    """Logistic regression over the out-of-fold probabilities of base models; returns the model and its inputs.

    The rows of a fold pass through all its models at once, so nothing is shuffled. ``models`` are those of :func:`fold_fits`, if known.
    """
    models = models or fold_fits(df, features, names, key, fold, label, **params)
    rows = df.select(key, fold, F.col(label).cast("double").alias("_y"), *[f for f in features if f not in (key, fold)])
    parts = [stacked(rows.filter(F.col(fold) == f), [models[(n, f)] for n in names], labels) for f in dict.fromkeys(f for _, f in models if f is not None)]
    meta = materialize(reduce(DataFrame.unionByName, parts).select(
        key, F.col("_y").alias("label"), array_to_vector(F.concat(*[F.col(f"_p{i}") for i in range(len(names))])).alias("features")))
    weighted = with_class_weights(meta, "label")
    top = Pipeline(stages=[LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=100, regParam=0.01)]).fit(weighted)
    return top, meta


@dataclass(frozen=True)
class StackedModel:
    """Base models fitted on all training rows under a meta model fitted on their out-of-fold probabilities."""

    base: list[PipelineModel]
    top: PipelineModel
    labels: Sequence[int]

    def predictions(self, rows: DataFrame, key: str, truth: str = "label") -> DataFrame:
        """Prediction table of rows that the model need not have seen; one pass, no join."""
        out = stacked(rows.select(key, truth, *[c for c in rows.columns if c not in (key, truth)]), self.base, self.labels)
        vector = array_to_vector(F.concat(*[F.col(f"_p{i}") for i in range(len(self.base))]))
        return predictions(self.top, out.select(key, F.col(truth).alias("label"), vector.alias("features")), [key], "label", self.labels)


def fit_stack(df: DataFrame, features: Sequence[str], names: Sequence[str], key: str, label: str = "label",
              labels: Sequence[int] = K.GRADES, **params) -> StackedModel:
    """Stacking over the folds in ``df``: the meta model learns from held-out rows, the base models are then refitted on all."""
    models = fold_fits(df, features, names, key, label=label, whole=True, **params)
    top, _ = stack(df, features, names, key, label, labels, models=models)
    return StackedModel([models[(name, None)] for name in names], top, labels)


# -- calibration -------------------------------------------------------------------------------

def calibrators(fit_rows: DataFrame, score: str, positive: Column) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Functions that add ``calibrated`` to a scored table: unchanged, sigmoid and isotonic."""
    rows = fit_rows.select(F.col(score).alias("_s"), positive.cast("double").alias("label"))
    assembler = VectorAssembler(inputCols=["_s"], outputCol="_v")
    sigmoid = Pipeline(stages=[assembler, LogisticRegression(featuresCol="_v", labelCol="label", probabilityCol="_prob",
                                                             rawPredictionCol="_raw", predictionCol="_pred")]).fit(rows)
    isotonic = IsotonicRegression(featuresCol="_s", labelCol="label", predictionCol="calibrated").fit(rows)

    def by_sigmoid(df: DataFrame) -> DataFrame:
        out = sigmoid.transform(df.withColumn("_s", F.col(score)))
        return out.withColumn("calibrated", vector_to_array("_prob")[1]).drop("_s", "_v", "_prob", "_raw", "_pred")

    return {
        "uncalibrated": lambda df: df.withColumn("calibrated", F.col(score)),
        "sigmoid": by_sigmoid,
        "isotonic": lambda df: isotonic.transform(df.withColumn("_s", F.col(score))).drop("_s"),
    }


def calibration_tables(fit_rows: DataFrame, rows: DataFrame, score: str, positive: Column, model: str = "model") -> DataFrame:
    """:func:`calibration_table` of every model in the rows, one fit per model and calibration."""
    names = [r[model] for r in fit_rows.select(model).distinct().collect()]
    parts = [calibration_table(fit_rows.filter(F.col(model).eqNullSafe(F.lit(n))), rows.filter(F.col(model).eqNullSafe(F.lit(n))), score, positive)
             .select(F.lit(n).alias(model), "*") for n in names]
    return reduce(DataFrame.unionByName, parts)


def calibration_table(fit_rows: DataFrame, rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """AUC, Brier score and log loss per calibration on held-out rows, best first (AUC, then Brier)."""
    parts = None
    for name, apply in calibrators(fit_rows, score, positive).items():
        part = apply(rows).select(F.lit(name).alias("calibration"), "calibrated", positive.alias("_y"))
        parts = part if parts is None else parts.unionByName(part)
    y = F.col("_y")
    brier = parts.groupBy("calibration").agg(F.avg(F.pow(F.col("calibrated") - y.cast("double"), 2)).alias("brier"))
    loss = M.log_loss(parts, ["calibration"], "calibrated", y)
    area = M.auc(parts, ["calibration"], "calibrated", y).select("calibration", "auc")
    table = area.join(brier, "calibration").join(loss, "calibration")
    order = Window.partitionBy().orderBy(F.desc(F.round("auc", 9)), "brier", "calibration")
    return table.withColumn("rank", F.row_number().over(order).cast("bigint"))


# -- importance --------------------------------------------------------------------------------

def native_importance(model: PipelineModel | ForestModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """Importance known to the fitted classifier: tree importances or mean absolute coefficients."""
    if isinstance(model, ForestModel):
        return model.importance()
    top = None if isinstance(model, BoosterModel) else model.stages[-1]
    if hasattr(top, "coefficientMatrix"):
        values = abs(top.coefficientMatrix.toArray()).mean(axis=0)
    else:
        raise ValueError("the classifier has no native importance")
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, score double")


def shifted(df: DataFrame, column: str, key: str, seed: int, rows_per_bucket: int = 5000) -> DataFrame:
    """Add ``<column>_shuffled``: the value of the next row in a random (hash) order.

    Rows are shuffled inside hash buckets of bounded size, in a ring, so every value is used once.
    """
    n = df.count()
    digits = 0
    while n / 16 ** digits > rows_per_bucket:
        digits += 1
    hashed = df.withColumn("_h", hash_order(seed, key)).withColumn("_b", F.substring("_h", 1, digits))
    w = Window.partitionBy("_b").orderBy("_h", key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.lead(column).over(w)
    first = F.first(column).over(whole)
    return hashed.withColumn(f"{column}_shuffled", F.coalesce(following, first)).drop("_h", "_b")


def permutation_importance(model: PipelineModel, rows: DataFrame, features: Sequence[str], key: str, repeats: int = 2,
                           label: str = "label", labels: Sequence[int] = K.GRADES) -> DataFrame:
    """Drop of macro F1 when one feature is shuffled: mean and population deviation over the repeats.

    Every row is scored once as it is and once per feature, in a single job per repeat.
    """
    every = F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))).alias("variant")
    if isinstance(model, (ForestModel, BoosterModel)):
        base = materialize(model.bins.apply(rows.select(key, F.col(label).cast("int").alias("y_true"), *features), [key, "y_true"]).withColumnRenamed("bins", "x"))
        place = F.array(*[F.lit(model.bins.features.index(f)) for f in features])[F.col("variant")]
        mixed = F.when(F.col("variant") < 0, F.col("x")).otherwise(F.concat(
            F.substring("x", F.lit(1), place), F.substring("x_shuffled", place + 1, F.lit(1)), F.substring("x", place + 2, F.lit(len(model.bins.features)))))

        def score(both: DataFrame) -> DataFrame:
            voted = model.votes(both.select("y_true", "x", "x_shuffled", every).select("y_true", "variant", mixed.alias("bins")), ["variant", "y_true"])
            return voted.select("variant", "y_true", first_argmax("prob").cast("int").alias("y_pred"))
    else:
        prepare = PipelineModel(stages=[s for s in model.stages[:-1] if not isinstance(s, (RandomFourierFeatures, LandmarkKernelModel))])
        classify = PipelineModel(stages=model.stages[len(prepare.stages):])
        base = materialize(prepare.transform(rows).select(key, F.col(label).cast("int").alias("y_true"), vector_to_array("features").alias("x")))

        def score(both: DataFrame) -> DataFrame:
            variants = both.select("y_true", "x", "x_shuffled", every)
            changed = F.transform("x", lambda v, i: F.when(i == F.col("variant"), F.element_at("x_shuffled", i + 1)).otherwise(v))
            scored = classify.transform(variants.select("y_true", "variant", array_to_vector(changed).alias("features")))
            return scored.select("variant", "y_true", F.col("prediction").cast("int").alias("y_pred"))

    tables = None
    for repeat in range(repeats):
        table = M.evaluate(score(shifted(base, "x", key, K.SEED + repeat)), ["variant"], labels)
        table = table.select(F.lit(repeat).alias("repeat"), "variant", "macro_f1")
        tables = table if tables is None else tables.unionByName(table)
    plain = F.max(F.when(F.col("variant") == -1, F.col("macro_f1"))).over(Window.partitionBy("repeat"))
    drops = tables.withColumn("drop", plain - F.col("macro_f1")).filter("variant >= 0")
    names = F.array(*[F.lit(f) for f in features])
    return drops.groupBy("variant").agg(F.avg("drop").alias("score"), F.stddev_pop("drop").alias("deviation")).select(
        names[F.col("variant")].alias("feature"), "score", "deviation")


# -- scoring, persistence ----------------------------------------------------------------------

def score_batch(model: PipelineModel, rows: DataFrame, key: str, order: Column, features: Sequence[str] = ()) -> DataFrame:
    """Unlabelled rows with class, name, confidence and probabilities; ``position`` keeps the input order."""
    out = predictions(model, rows.withColumn("position", order), [key, "position", *features], truth=None)
    return out.select(key, "position", F.col("y_pred").alias("predicted_class"), grade_name(F.col("y_pred")).alias("class_name"),
                      F.array_max("prob").alias("confidence"), "prob", *features)


def save_model(model: PipelineModel | ForestModel | BoosterModel, path: str, features: Sequence[str], threshold: float | None = None, **extra) -> None:
    """The pipeline, and next to it one JSON document with feature order, threshold and other metadata."""
    if isinstance(model, (ForestModel, BoosterModel)):
        model.save(path)
    else:
        model.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.getActiveSession()
    kind = {"kind": k for k, of in (("forest", ForestModel), ("booster", BoosterModel)) if isinstance(model, of)}
    document = json.dumps({"features": list(features), "threshold": threshold, **kind, **extra}, sort_keys=True)
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel | ForestModel | BoosterModel, dict]:
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    if metadata.get("kind") == "forest":
        return ForestModel.load(spark, path), metadata
    if metadata.get("kind") == "booster":
        return BoosterModel.load(spark, path), metadata
    return PipelineModel.load(f"{path}/pipeline"), metadata
