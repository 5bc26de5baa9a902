"""Catalogue of feature versions over a hybrid table, and the grid of models over it.

A hybrid table has measured features and, per source network, prediction columns ``cnn_<source>__<name>`` and embedding
columns ``cnn_embed_<source>_<position>``. A version is a list of these columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.functions.probability import first_argmax
from gradewell.models import forests, logistic
from gradewell.models.prep import fit_preparation
from gradewell.models.training import estimator, forest_params, macro_scores
from gradewell.operators.splits import with_class_weights
from gradewell.session import materialize

# Name parts of prediction columns (fixed values).
UNCERTAINTY_PARTS = ("entropy", "uncertainty", "margin", "max_probability")
PROBABILITY_PARTS = ("prob_class", "referable_probability")

GRID = ("model string, feature_version string, feature_count int, status string, val_macro_f1 double, val_balanced_accuracy double, "
        "macro_f1 double, balanced_accuracy double, error string")


def source_of(column: str) -> str | None:
    """The network a prediction or embedding column comes from; None for other columns."""
    if column.startswith("cnn_embed_"):
        return column.removeprefix("cnn_embed_").rsplit("_", 1)[0]
    if column.startswith("cnn_") and "__" in column:
        return column.removeprefix("cnn_").split("__", 1)[0]
    return None


def build_versions(columns: Sequence[str], base: Sequence[str], selected: Sequence[str], best: str | None = None,
                   first: int = 100, narrow: int = 64) -> dict[str, list[str]]:
    """The fourteen versions of a table with these columns.

    ``base`` are the measured features, ``selected`` a choice of them; ``best`` names the best network (None: all count as
    best). ``first`` and ``narrow`` are the lengths of the short feature list and of the short embedding. Names that the table
    lacks are left out, so a version may be empty.
    """
    known = set(columns)
    base = [c for c in base if c in known]
    chosen, head = [c for c in selected if c in known], base[:first]
    embedded = [c for c in columns if c.startswith("cnn_embed_")]
    said = [c for c in columns if source_of(c) is not None and not c.startswith("cnn_embed_")]
    of = lambda names, network: [c for c in names if source_of(c) == network]
    best_said, best_embedded = (of(said, best), of(embedded, best)) if best else (said, embedded)
    short = best_embedded[:narrow]
    combined = [c for network in sorted({source_of(c) for c in said}) for c in of(embedded, network)[:narrow]]
    having = lambda parts: [c for c in said if any(p in c for p in parts)]
    return {
        "v1_base_best_predictions": base + best_said,
        "v2_base_best_short_embedding": base + short,
        "v3_base_best_embedding": base + best_embedded,
        "v4_base_best_predictions_short_embedding": base + best_said + short,
        "v5_base_best_predictions_embedding": base + best_said + best_embedded,
        "v6_selected_best_predictions": chosen + best_said,
        "v7_selected_best_predictions_embedding": chosen + best_said + best_embedded,
        "v8_first_best_predictions_embedding": head + best_said + best_embedded,
        "v9_base_all_predictions": base + said,
        "v10_base_all_predictions_combined_embedding": base + said + combined,
        "v11_base_only": base,
        "v12_networks_only": said + combined,
        "v13_base_uncertainty": base + having(UNCERTAINTY_PARTS),
        "v14_base_probabilities": base + having(PROBABILITY_PARTS),
    }


def prepared_parts(train: DataFrame, held: DataFrame, columns: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Training rows (label, vector, weight) and held rows (label, vector, part), stored.

    All columns are filled, scaled and assembled once, with values of the training rows; a model is given a slice.
    """
    preparation = PipelineModel(stages=fit_preparation(train, columns).stage("_all"))

    def prepared(rows: DataFrame, *keep: str) -> DataFrame:
        return materialize(preparation.transform(rows.withColumn("label", F.col(label).cast("double"))).select("label", "_all", *keep))

    return prepared(with_class_weights(train.withColumn("label", F.col(label).cast("double")), "label").filter("label is not null"), "weight"), prepared(held, "_part")


def sliced(known: DataFrame, unseen: DataFrame, columns: Sequence[str]) -> Callable[..., DataFrame]:
    """A function of (model, columns, parameters) that fits on a slice of the training rows and predicts the held ones."""
    classes = known.agg((F.max("label") + 1).cast("int")).first()[0]

    def scored(name: str, features: Sequence[str], **params) -> DataFrame:
        cut = VectorSlicer(inputCol="_all", outputCol="features", indices=[columns.index(c) for c in features])
        model = Pipeline(stages=[cut, *estimator(name, classes, **params)]).fit(known)
        return model.transform(unseen).select("_part", F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))

    return scored


def bayes_counts(known: DataFrame, unseen: DataFrame, columns: Sequence[str], versions: Mapping[str, Sequence[str]]) -> dict[str, list]:
    """Rows (_part, y_true, y_pred, count) of Gaussian naive Bayes per version: one pass to fit all versions, one to judge them.

    A column's moments per class are the same in every version; only the small variance that is added for stability differs
    (1e-9 of the largest one of the version's columns, as in Spark ML).
    """
    summary = Summarizer.metrics("mean", "normL2").summary(F.col("_all"), F.col("weight"))
    found = known.groupBy("label").agg(F.sum("weight").alias("w"), summary.alias("s")).select("label", "w", "s.*").orderBy("label").collect()
    classes = np.array([int(r["label"]) for r in found])
    weight = np.array([r["w"] for r in found])
    mean = np.array([r["mean"].toArray() for r in found])
    squares = np.array([r["normL2"].toArray() ** 2 for r in found])
    variance = squares / weight[:, None] - mean ** 2
    whole = squares.sum(axis=0) / weight.sum() - ((mean * weight[:, None]).sum(axis=0) / weight.sum()) ** 2
    places = {v: [columns.index(c) for c in dict.fromkeys(features)] for v, features in versions.items() if features}
    spreads = {v: variance[:, at] + 1e-9 * whole[at].max() for v, at in places.items()}
    prior = np.log(weight) - np.log(weight.sum())

    def score(x: np.ndarray, version: str) -> np.ndarray:
        ours = x[:, places[version]]
        spread, centre = spreads[version], mean[:, places[version]]
        scores = [prior[k] - (((ours - centre[k]) ** 2 / spread[k]).sum(axis=1) + np.log(spread[k]).sum()) / 2 for k in range(len(classes))]
        return classes[np.argmax(scores, axis=0)]

    return judged(unseen, list(places), score)


def logistic_counts(known: DataFrame, unseen: DataFrame, columns: Sequence[str], versions: Mapping[str, Sequence[str]], classes: int, **params) -> dict[str, list]:
    """Rows (_part, y_true, y_pred, count) of logistic regression per version: a pass per step fits all versions, one judges them."""
    places = {v: [columns.index(c) for c in dict.fromkeys(features)] for v, features in versions.items() if features}
    models = logistic.fit_slices(known, len(columns), classes, places, **params)
    return judged(unseen, list(places), lambda x, version: np.argmax(x @ models[version][1:] + models[version][0], axis=1))


def judged(unseen: DataFrame, versions: Sequence[str], predict: Callable[[np.ndarray, str], np.ndarray]) -> dict[str, list]:
    """Rows (_part, y_true, y_pred, count) per version, from one pass; ``predict`` gives the classes of rows x by a version."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            rows = batch.select(["_part", "y_true"])
            for version in versions:
                said = pa.array(predict(x, version), pa.int32())
                counted = pa.Table.from_batches([rows]).append_column("y_pred", said).group_by(["_part", "y_true", "y_pred"]).aggregate([([], "count_all")])
                names = ["_part", "y_true", "y_pred", "count_all"]
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(counted), pa.string()), *[counted.column(c).combine_chunks() for c in names]], names=["version", *names[:3], "n"])

    rows = unseen.select("_part", F.col("label").cast("int").alias("y_true"), vector_to_array("_all").alias("x"))
    counts = rows.mapInArrow(judge, "version string, _part string, y_true int, y_pred int, n bigint").groupBy("version", "_part", "y_true", "y_pred").agg(F.sum("n").alias("count"))
    out: dict[str, list] = {v: [] for v in versions}
    for r in counts.collect():
        out[r["version"]].append(r)
    return out


def binned(train: DataFrame, held: DataFrame, columns: Sequence[str], label: str, key: str) -> Callable[..., DataFrame]:
    """As :func:`sliced` for forests: columns are cut into bins once; a forest tries the bins of its version only."""
    rows = forests.prepare(train, columns, [key], label)
    unseen = materialize(rows.bins.apply(held.withColumn("y_true", F.col(label).cast("int")), ["_part", "y_true"]))

    def scored(name: str, features: Sequence[str], **params) -> DataFrame:
        model = forests.grow_forest(rows, name, features=features, **forest_params(params))
        return model.votes(unseen, ["_part", "y_true"]).withColumn("y_pred", first_argmax("prob"))

    return scored


def version_grid(train: DataFrame, validation: DataFrame, test: DataFrame, versions: Mapping[str, Sequence[str]],
                 models: Mapping[str, Mapping], key: str, label: str = "label", labels: Sequence[int] = K.GRADES, parallel: int = 4) -> DataFrame:
    """Every model (name to parameters) on every version: metrics on validation and test rows, ranked by the validation rows.

    Each version costs one fit per model and no preparation: that is done once for the union of all columns; naive Bayes without
    parameters is fitted and judged for all versions at once, and so is logistic regression of more than two classes, a pass per step.
    ``parallel`` other fits run side by side, and only counts per (truth, prediction) come to the driver. A version without columns is listed with
    status ``failed`` and no rank. Equal ranks are told apart by the smaller number of features, then by name. Rows without
    a label are not judged.
    """
    spark = train.sparkSession
    columns = list(dict.fromkeys(c for features in versions.values() for c in features))
    held = validation.withColumn("_part", F.lit("val")).unionByName(test.withColumn("_part", F.lit("test"))).filter(F.col(label).isNotNull())
    ways: dict[bool, Callable[..., DataFrame]] = {}
    counts_of: dict[tuple[str, str], list] = {}
    for as_forest in {name in forests.KINDS for name in models} if columns else ():
        if as_forest:
            ways[True] = binned(train, held, columns, label, key)
            continue
        known, unseen = prepared_parts(train, held, columns, label)
        if models.get("naive_bayes", True) == {}:
            counts_of |= {("naive_bayes", v): rows for v, rows in bayes_counts(known, unseen, columns, versions).items()}
        present = {int(r["label"]) for r in known.select("label").distinct().collect()}
        if set(models.get("logistic_regression", {"": 0})) <= {"maxIter", "regParam"} and len(present) > 2 and present == set(range(len(present))):
            found = logistic_counts(known, unseen, columns, versions, len(present), **models["logistic_regression"])
            counts_of |= {("logistic_regression", v): rows for v, rows in found.items()}
        ways[False] = sliced(known, unseen, columns)

    def run(name: str, version: str) -> tuple:
        features = list(dict.fromkeys(versions[version]))
        if not features:
            return name, version, 0, "failed", None, None, None, None, "no columns"
        counted = counts_of.get((name, version))
        if counted is None:
            counted = ways[name in forests.KINDS](name, features, **models[name]).groupBy("_part", "y_true", "y_pred").count().collect()
        values = []
        for part in ("val", "test"):
            counts = Counter({(r["y_true"], r["y_pred"]): r["count"] for r in counted if r["_part"] == part})
            present = {t for t, _ in counts}
            f1, recall = macro_scores(counts, labels)
            values += [f1, recall * len(labels) / len(present) if present else None]
        return name, version, len(features), "ok", *values, None

    pairs = [(name, version) for version in versions for name in models]
    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(lambda pair: run(*pair)), pairs))
    # One row per model and version: a table of the size of the catalogue.
    order = Window.orderBy(F.desc_nulls_last(F.round("val_macro_f1", 9)), F.desc(F.round("val_balanced_accuracy", 9)), "feature_count", "model", "feature_version")
    return spark.createDataFrame(rows, GRID).withColumn("rank", F.when(F.col("status") == "ok", F.row_number().over(order)).cast("bigint"))
