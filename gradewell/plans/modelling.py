"""Queries that fit and apply models on the feature table. Models are small; rows are all used."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.models import boosting as B, forests as R, prep, training as T, versions as V
from gradewell.operators import metrics as M
from gradewell.operators import profile as P
from gradewell.operators import splits as S
from gradewell.plans.evaluation import CONFUSION, METRICS, SUMMARY_OUT
from gradewell.plans.fixtures import EMBEDDED, FEATURES, NETWORKS
from gradewell.plans.profiling import long_sql
from gradewell.plans.registry import CATALOG
from gradewell.plans.splits import split_sql
from gradewell.plans.tools import tidy
from gradewell.session import materialize, shared_folder

query = CATALOG.query
INPUTS = ["n_lines", "qty_sum", "qty_max", "price_max", "tax_max", "total", "disc_max"]
FOLDS = 5
#: Sizes of the reference's models; a depth of None is no limit.
LOGISTIC = {"maxIter": 5000}
FOREST = {"numTrees": 240, "maxDepth": None, "minInstancesPerNode": 2}
EXTRA_TREES = {"numTrees": 240, "maxDepth": None, "minInstancesPerNode": 2}
BALANCED_FOREST = {"numTrees": 220, "maxDepth": None, "minInstancesPerNode": 2}
BOOSTED = {"maxIter": 220, "maxDepth": 5, "stepSize": 0.06, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.85"}
BOOSTED_GRADES = {"rounds": 220, "depth": 5, "rate": 0.06, "share": 0.9, "feature_share": 0.85}
NATIVE_FOREST, PERMUTED_FOREST = FOREST | {"numTrees": 180}, FOREST | {"numTrees": 120}
TRIALS = 50
#: 4 to 10 trees where the reference has 120 to 320: 50 trials of five folds must end in minutes on one machine.
TRIAL_RANGES = {"numTrees": [4, 6, 8, 10], "maxDepth": [None, 6, 10, 14, 18], "minInstancesPerNode": (1, 8), "featureSubsetStrategy": ["sqrt", "log2", "all"]}


def split(fx):
    """(train, test) of the feature table by a stratified hash split.

    The table is written with its parts: fitting reads it many times and must neither derive it nor place its rows again.
    """
    table = materialize(S.stratified_split(fx.feats_once, ["label"], "row_id", 0.2, 0.2))
    return table.filter("split <> 'test'"), table.filter("split = 'test'")


TRAIN = f"{split_sql('0.2', '0.2')}, train as (select * from sp where split<>'test')"


@query("m01_train_medians", "feats", f"""with {TRAIN}, {long_sql(INPUTS, 'train')}, m as (select feature, coalesce(quantile_cont(v,0.5),0) as med from long group by feature)
select row_id, coalesce(disc_max, (select med from m where feature='disc_max')) as disc_max from sp where split='test'""")
def train_medians(fx):
    train, test = split(fx)
    return P.fill_medians(test, INPUTS, P.medians(train, INPUTS)).select("row_id", "disc_max")


SCALED = """select row_id, round((qty_sum-(select avg(qty_sum) from train))/(select stddev_pop(qty_sum) from train),6) as qty_sum_standard,
  round((qty_sum-(select quantile_cont(qty_sum,0.5) from train))/(select quantile_cont(qty_sum,0.75)-quantile_cont(qty_sum,0.25) from train),6) as qty_sum_robust,
  round((total-(select avg(total) from train))/(select stddev_pop(total) from train),6) as total_standard,
  round((total-(select quantile_cont(total,0.5) from train))/(select quantile_cont(total,0.75)-quantile_cont(total,0.25) from train),6) as total_robust from sp where split='test'"""


@query("m02_scaled_features", "feats", f"with {TRAIN} {SCALED}")
def scaled_features(fx):
    train, test = split(fx)
    out = test.select("row_id", "qty_sum", "total")
    for kind in ("standard", "robust"):
        fitted = prep.fit_preparation(train, ["qty_sum", "total"], kind)
        out = out.withColumns({f"{f}_{kind}": (F.col(f) - fitted.centre[f]) / fitted.scale[f] for f in ("qty_sum", "total")})
    return tidy(out.drop("qty_sum", "total"))


def bayes_sql(source: str, held: str) -> str:
    """Gaussian naive Bayes with equal class weights as the CTE ``pred``: rows of the folds ``held`` by the other folds.

    Missing cells take the median of the fitting rows. Scaling a column does not change the answer.
    """
    cells = " union all ".join(f"select row_id, label, fold, '{c}' as feature, {c}::double as v from {source}" for c in INPUTS)
    return f"""cells as ({cells}), held as ({held}),
med as (select f, feature, coalesce(quantile_cont(v,0.5),0) as med from cells join held on fold<>f group by all),
fitted as (select f, label as k, feature, avg(coalesce(v,med)) as mu, var_pop(coalesce(v,med)) as s2 from cells join held on fold<>f join med using (f, feature) group by all),
scored as (select row_id, fold, label as y_true, k, sum(-ln(s2)/2 - pow(coalesce(v,med)-mu,2)/(2*s2)) as s
  from cells c join med m on m.f=c.fold and m.feature=c.feature join fitted t on t.f=c.fold and t.feature=c.feature group by all),
pred as (select row_id, fold, y_true, arg_max(k, s)::int as y_pred from scored group by row_id, fold, y_true)"""


def evaluated(fx, name, features=INPUTS, binary=False, parts=None, preparation=None, **params):
    """Holdout metrics of one model; several models of a query share the parts of the table and their preparation."""
    train, test = parts or split(fx)
    label, labels = "label", K.GRADES
    if binary:
        train, test = (t.withColumn("label", (F.col("label") >= K.POSITIVE_MIN_GRADE).cast("int")) for t in (train, test))
        labels = [0, 1]
    model = T.fit(train, features, name, label, key="row_id", preparation=preparation, **params)
    scored = T.predictions(model, test, ["row_id"], label, labels).withColumn("model", F.lit(name))
    return M.evaluate(scored, ["model"], labels)


def prepared(fx):
    """Split and preparation, made once, for several calls of :func:`evaluated`."""
    parts = split(fx)
    return {"parts": parts, "preparation": prep.fit_preparation(parts[0], INPUTS)}


@query("m03_pipeline_grid")
def pipeline_grid(fx):
    """Scaler and feature engineering chosen by out-of-fold metrics of one classifier."""
    base = ["ma_count", "ma_area", "hemorrhage_area", "vessel_density", "glcm_contrast"]
    engineered = [*base, "burden_lesion_burden", "burden_exudate_burden"]
    table = prep.BurdenFeatures().transform(fx.measures).select("row_id", "label", *engineered)
    folds = materialize(S.stratified_folds(materialize(table), ["label"], "row_id", FOLDS))
    numbers = list(range(FOLDS))
    preparations = prep.fit_preparations(folds, engineered, ["standard", "robust"], "fold", numbers, numbers)
    parts = None
    for scaler in ("standard", "robust"):
        for name, columns in (("base", base), ("engineered", engineered)):
            oof = T.out_of_fold(folds, columns, "naive_bayes", "row_id", scaler=scaler, preparations=preparations)
            part = oof.select("y_true", "y_pred", F.lit(scaler).alias("scaler"), F.lit(name).alias("engineering"))
            parts = part if parts is None else parts.unionByName(part)
    return tidy(M.evaluate(parts, ["scaler", "engineering"]).select("scaler", "engineering", "macro_f1", "macro_recall"))


@query("m04_logistic_regression")
def logistic_regression(fx):
    shared = prepared(fx)
    return evaluated(fx, "logistic_regression", **shared, **LOGISTIC).unionByName(
        evaluated(fx, "logistic_regression", binary=True, **shared, **LOGISTIC), allowMissingColumns=True)


@query("m05_forests")
def forests(fx):
    """Three kinds of forests grown from one table of binned rows."""
    train, test = split(fx)
    rows = R.prepare(train, INPUTS, ["row_id"])
    parts = None
    for kind, sizes in (("random_forest", FOREST), ("extra_trees", EXTRA_TREES), ("balanced_forest", BALANCED_FOREST)):
        model = R.grow_forest(rows, kind, **T.forest_params(sizes))
        part = T.predictions(model, test, ["row_id"]).select(F.lit(kind).alias("model"), "y_true", "y_pred")
        parts = part if parts is None else parts.unionByName(part)
    return M.evaluate(parts, ["model"])


@query("m06_boosted_trees")
def boosted_trees(fx):
    return evaluated(fx, "boosted_trees", binary=True, **BOOSTED)


@query("m06_boosted_trees_grades")
def boosted_trees_grades(fx):
    """One softmax booster, five trees a round."""
    train, test = split(fx)
    model = B.grow_booster(R.prepare(train, INPUTS, ["row_id"], max_bins=32), **BOOSTED_GRADES)
    return M.evaluate(T.predictions(model, test, ["row_id"]).withColumn("model", F.lit("boosted_trees")), ["model"])


@query("m07_naive_bayes", "feats", f"""with {split_sql('0.2', '0.2')}, parts as (select *, case when split='test' then 0 else 1 end as fold from sp),
{bayes_sql('parts', 'select 0 as f')}, graded as (select 'naive_bayes' as model, row_id, y_true, y_pred from pred),
{CONFUSION.replace('preds', 'graded')}, {METRICS} {SUMMARY_OUT}""")
def naive_bayes(fx):
    return tidy(evaluated(fx, "naive_bayes"))


@query("m08_support_vectors")
def support_vectors(fx):
    shared = prepared(fx)
    return evaluated(fx, "linear_svm", binary=True, **shared, maxIter=3000).unionByName(
        evaluated(fx, "kernel_svm", binary=True, **shared, landmarks=256))


def folded(fx, folds=FOLDS):
    return materialize(S.stratified_folds(materialize(fx.feats.select("row_id", "label", *INPUTS)), ["label"], "row_id", folds))


@query("g06_out_of_fold", "feats", f"""with parts as (select *, (ntile(5) over (partition by label order by md5('42|' || row_id), row_id) - 1)::int as fold from feats),
{bayes_sql('parts', 'select unnest(range(5)) as f')} select row_id, fold, y_true, y_pred from pred""")
def out_of_fold(fx):
    oof = T.out_of_fold(folded(fx), INPUTS, "naive_bayes", "row_id")
    return oof.select("row_id", "fold", "y_true", "y_pred")


@query("m10_cross_validation")
def cross_validation(fx):
    metrics = T.cross_validate(folded(fx), INPUTS, ["logistic_regression", "naive_bayes"], "row_id")
    return tidy(S.fold_summary(metrics, ["model"], ["accuracy", "balanced_accuracy", "macro_f1", "macro_recall", "quadratic_kappa"]))


@query("m11_parameter_search")
def parameter_search(fx):
    table = folded(fx)
    candidates = T.random_candidates(TRIAL_RANGES, TRIALS)
    return tidy(T.search(table, INPUTS, "random_forest", candidates, "row_id", parallel=8))


@query("m13_stacking")
def stacking(fx):
    """Base and meta models of the training rows, judged on rows neither has seen."""
    train, test = split(fx)
    folds = materialize(S.stratified_folds(train.select("row_id", "label", *INPUTS), ["label"], "row_id", FOLDS))
    model = T.fit_stack(folds, INPUTS, ["logistic_regression", "naive_bayes"], "row_id")
    scored = model.predictions(test, "row_id").withColumn("model", F.lit("stacking"))
    return tidy(M.evaluate(scored, ["model"]).select("model", "n_rows", "accuracy", "macro_f1", "quadratic_kappa"))


@query("m14_calibration")
def calibration(fx):
    rows = materialize(fx.preds.select("model", "row_id", "score", "y_true"))
    table = materialize(S.stratified_split(rows, ["model", "y_true"], "row_id", 0.3, 0.5))
    y = F.col("y_true") >= K.POSITIVE_MIN_GRADE
    return tidy(T.calibration_tables(table.filter("split = 'val'"), table.filter("split = 'test'"), "score", y))


@query("m17_native_importance")
def native_importance(fx):
    train, _ = split(fx)
    return tidy(T.native_importance(T.fit(train, INPUTS, "random_forest", key="row_id", **NATIVE_FOREST), INPUTS, fx.spark))


@query("m17_permutation_importance")
def permutation_importance(fx):
    train, test = split(fx)
    model = T.fit(train, INPUTS, "random_forest", key="row_id", **PERMUTED_FOREST)
    return tidy(T.permutation_importance(model, test, INPUTS, "row_id", repeats=2))


@query("m18_embedding_pca")
def embedding_pca(fx):
    """Components fitted on training vectors and applied to all, with the explained share of each."""
    vectors = prep.embedding_vectors(fx.table("embeddings"), "embedding")
    table = S.stratified_split(materialize(vectors), ["label"], "vec_id", 0.2, 0.2)
    model, explained = prep.fit_pca(table.filter("split = 'train'"), "vector", 8)
    from pyspark.ml.functions import vector_to_array
    out = model.transform(table).select("vec_id", "split", vector_to_array("components").alias("c"))
    share = F.array(*[F.lit(v) for v in explained])
    return tidy(out.select("vec_id", "split", F.posexplode("c").alias("component", "value"))
                .withColumn("explained", share[F.col("component")]).withColumn("value", F.abs("value")))


HYBRID = [f"cnn_{m}__{n}" for m in NETWORKS for n in [*[f"prob_class_{k}" for k in range(5)], "referable_probability", "max_probability", "entropy", "margin"]]
HYBRID += [f"cnn_embed_{m}_{j:03d}" for m in NETWORKS for j in range(EMBEDDED)]
VERSIONS = V.build_versions([*INPUTS, *HYBRID], INPUTS, ["n_lines", "qty_sum", "total"], "m1", first=5, narrow=6)


def version_grid(fx, models):
    table = materialize(S.stratified_split(materialize(fx.hybrid.select("row_id", "label", *INPUTS, *HYBRID)), ["label"], "row_id", 0.2, 0.2))
    parts = [table.filter(F.col("split") == name) for name in ("train", "val", "test")]
    out = V.version_grid(*parts, VERSIONS, models, "row_id")
    return tidy(out.select("model", "feature_version", "feature_count", "rank", "val_macro_f1", "val_balanced_accuracy", "macro_f1", "balanced_accuracy"))


MEMBERS = ", ".join(f"('{v}', '{c}')" for v, columns in VERSIONS.items() for c in columns)
HYBRID_CELLS = " union all ".join(f"select row_id, label, split, '{c}' as feature, {c}::double as v from sp" for c in [*INPUTS, *HYBRID])


@query("m19_bayes_versions", "hybrid", f"""with {split_sql('0.2', '0.2', 'hybrid')}, members as (select * from (values {MEMBERS}) as t(version, feature)),
raw as ({HYBRID_CELLS}), med as (select feature, coalesce(quantile_cont(v,0.5),0) as med from raw where split='train' group by 1),
cells as (select row_id, label, split, feature, coalesce(v, med) as v from raw join med using (feature)),
fitted as (select label as k, feature, avg(v) as mu, var_pop(v) as s2 from cells where split='train' group by all),
logs as (select row_id, split, label, c.feature, k, -ln(s2)/2 - pow(v-mu,2)/(2*s2) as s from cells c join fitted t on t.feature=c.feature where split<>'train'),
scored as (select version, row_id, split, label, k, sum(s) as s from logs join members using (feature) group by all),
pred as (select version, split, label as y_true, arg_max(k, s)::int as y_pred from scored group by version, row_id, split, label),
counts as (select version, split, y_true, y_pred, count(*) as n from pred group by all),
pc as (select version, split, k, sum(case when y_true=k and y_pred=k then n else 0 end) as tp, sum(case when y_true=k then n else 0 end) as sup,
  sum(case when y_pred=k then n else 0 end) as prd from counts cross join (select unnest(range(5)) as k) group by all),
scores as (select version, split, avg(case when sup+prd=0 then 0 else 2.0*tp/(sup+prd) end) as f1, avg(case when sup>0 then tp::double/sup end) as bal from pc group by all),
sizes as (select version, count(*)::int as feature_count from members group by 1),
joined as (select version, feature_count, v.f1 as vf, v.bal as vb, t.f1 as tf, t.bal as tb from sizes join scores v using (version) join scores t using (version) where v.split='val' and t.split='test')
select 'naive_bayes' as model, version as feature_version, feature_count, row_number() over (order by round(vf,9) desc, round(vb,9) desc, feature_count, version) as rank,
  round(vf,6) as val_macro_f1, round(vb,6) as val_balanced_accuracy, round(tf,6) as macro_f1, round(tb,6) as balanced_accuracy from joined""")
def bayes_versions(fx):
    return version_grid(fx, {"naive_bayes": {}})


@query("m19_feature_versions")
def feature_versions(fx):
    """Fourteen versions, two models, chosen on the validation rows."""
    return version_grid(fx, {"naive_bayes": {}, "logistic_regression": LOGISTIC})


BAYES_TEST = f"""with {split_sql('0.2', '0.2')}, parts as (select *, case when split='test' then 0 else 1 end as fold from sp), {bayes_sql('parts', 'select 0 as f')}"""
GRADE_LIST = ", ".join(f"'{name}'" for name in K.GRADE_NAMES.values())


@query("m20_batch_scoring", "feats", f"""{BAYES_TEST}, best as (select row_id, max(s) as most from scored group by 1),
shares as (select row_id, 1 / sum(exp(s - most)) as confidence from scored join best using (row_id) group by 1)
select row_id, row_id as position, y_pred as predicted_class, ([{GRADE_LIST}])[y_pred + 1] as class_name, round(confidence, 6) as confidence, total
from pred join shares using (row_id) join sp using (row_id)""")
def batch_scoring(fx):
    train, test = split(fx)
    model = T.fit(train, INPUTS, "naive_bayes")
    scored = T.score_batch(model, test.drop("label"), "row_id", F.col("row_id"), ["total"])
    return tidy(scored.select("row_id", "position", "predicted_class", "class_name", "confidence", "total"))


@query("m21_saved_model", "feats", f"""{BAYES_TEST} select row_id, y_pred, 0.5::double as threshold, 7 as n_features from pred""")
def saved_model(fx):
    """Predictions of a model that was saved with its metadata and loaded again."""
    train, test = split(fx)
    path = f"{shared_folder(fx.spark).rstrip('/')}/gradewell-models/{uuid.uuid4().hex}"
    T.save_model(T.fit(train, INPUTS, "naive_bayes"), path, INPUTS, threshold=0.5)
    model, metadata = T.load_model(fx.spark, path)
    scored = T.predictions(model, test.select("row_id", *metadata["features"]), ["row_id"], None)
    return scored.select("row_id", "y_pred", F.lit(metadata["threshold"]).alias("threshold"), F.lit(len(metadata["features"])).alias("n_features"))
