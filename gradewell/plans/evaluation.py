"""Queries over prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.operators import leaderboard as L
from gradewell.operators import metrics as M
from gradewell.plans.registry import CATALOG
from gradewell.plans.tools import doubles_sql, tidy

query = CATALOG.query
def positive():
    return F.col("y_true") >= K.POSITIVE_MIN_GRADE

LABELS = "lab as (select unnest([0,1,2,3,4]) as k)"

# Long confusion table per model, zero-filled.
CONFUSION = f"""{LABELS},
conf as (select m.model, a.k as y_true, b.k as y_pred, count(p.row_id) as n
  from (select distinct model from preds) m cross join lab a cross join lab b
  left join preds p on p.model=m.model and p.y_true=a.k and p.y_pred=b.k group by all)"""

# Per-class table over conf-like counts keyed by g.
def per_class_sql(conf: str, key: str) -> str:
    return f"""(select {key}, k as label,
    cast(sum(case when y_true=k and y_pred=k then n else 0 end) as bigint) as tp,
    cast(sum(case when y_true=k then n else 0 end) as bigint) as sup,
    cast(sum(case when y_pred=k then n else 0 end) as bigint) as prd
  from {conf} cross join lab group by {key}, k)"""


METRICS = f"""pc as (select *, case when prd=0 then 0 else tp::double/prd end as prec,
    case when sup=0 then 0 else tp::double/sup end as rec,
    case when sup+prd=0 then 0 else 2.0*tp/(sup+prd) end as f1 from {per_class_sql('conf', 'model')}),
tot as (select model, sum(n)::double as n_all, sum(case when y_true=y_pred then n else 0 end)::double as agree,
    sum(abs(y_true-y_pred)*n)::double as abs_err from conf group by model),
rs as (select model, y_true, sum(n)::double as r from conf group by all),
cs as (select model, y_pred, sum(n)::double as c from conf group by all),
kap as (select a.model,
    1 - sum(case when y_true<>y_pred then n else 0 end)/sum(case when y_true<>y_pred then r*c/n_all else 0 end) as k1,
    1 - sum(pow(y_true-y_pred,2)*n)/sum(pow(y_true-y_pred,2)*r*c/n_all) as k2
  from conf a join rs using (model, y_true) join cs using (model, y_pred) join tot using (model) group by a.model),
summary as (select model, n_all::bigint as n_rows, agree/n_all as accuracy,
    avg(case when sup>0 then rec end) as balanced_accuracy, avg(prec) as macro_precision, avg(rec) as macro_recall,
    avg(f1) as macro_f1, sum(f1*sup)/sum(sup) as weighted_f1, any_value(k1) as cohen_kappa, any_value(k2) as quadratic_kappa,
    any_value(abs_err)/n_all as mean_abs_error,
    {', '.join(f'max(case when label={i} then rec end) as class_{i}_recall' for i in range(5))}
  from pc join tot using (model) join kap using (model) group by model, n_all, agree)"""


def swept_sql(grid, source: str = "preds") -> str:
    """Binary metrics per model and threshold as the CTE ``sweep``."""
    bands = ", ".join(
        f"avg(case when score>={lo} and score<={hi} then 1.0::double else 0.0::double end) as {M.band_column(lo, hi)}"
        for lo, hi in K.UNCERTAINTY_BANDS)
    names = ", ".join(M.band_column(lo, hi) for lo, hi in K.UNCERTAINTY_BANDS)
    return f"""grid as (select unnest({doubles_sql(grid)}) as threshold),
raw as (select model, threshold,
    sum(case when y_true>=2 and score>=threshold then 1 else 0 end)::bigint as tp,
    sum(case when y_true<2 and score>=threshold then 1 else 0 end)::bigint as fp,
    sum(case when y_true>=2 and score<threshold then 1 else 0 end)::bigint as fn,
    sum(case when y_true<2 and score<threshold then 1 else 0 end)::bigint as tn,
    avg(case when greatest(score,1-score)<0.6 then 1.0::double else 0.0::double end) as uncertain_below_060, {bands}
  from {source} cross join grid group by all),
sweep as (select model, threshold, (tp+tn)::double/(tp+fp+fn+tn) as accuracy,
    ((case when tp+fn=0 then 0 else tp::double/(tp+fn) end)+(case when tn+fp=0 then 0 else tn::double/(tn+fp) end))
      /((case when tp+fn>0 then 1 else 0 end)+(case when tn+fp>0 then 1 else 0 end)) as balanced_accuracy,
    case when tp+fp=0 then 0 else tp::double/(tp+fp) end as "precision",
    case when tp+fn=0 then 0 else tp::double/(tp+fn) end as recall,
    case when 2*tp+fp+fn=0 then 0 else (2*tp)::double/(2*tp+fp+fn) end as f1,
    case when tn+fp=0 then 0 else tn::double/(tn+fp) end as negative_recall,
    fn as false_negatives, fp as false_positives, uncertain_below_060, {names} from raw)"""


AUC = """ranked as (select model, y_true>=2 as y, rank() over (partition by model order by score)
    + (count(*) over (partition by model, score) - 1)/2.0::double as r from preds),
aucs as (select model, sum(case when y then 1 else 0 end)::bigint as n_pos, sum(case when y then 0 else 1 end)::bigint as n_neg,
    (sum(case when y then r else 0 end) - n_pos*(n_pos+1)/2.0::double)/(n_pos::double*n_neg) as auc from ranked group by model)"""


@query("h01_confusion_long", "preds", f"with {CONFUSION} select model, y_true, y_pred, n from conf")
def confusion_long(fx):
    return M.confusion_long(M.confusion_wide(fx.preds, ["model"]), ["model"])


@query("h01_confusion_wide", "preds", f"with {CONFUSION} select model, "
       + ", ".join(f"sum(case when y_true={i} and y_pred={j} then n else 0 end)::bigint as c_{i}_{j}"
                   for i in range(5) for j in range(5)) + " from conf group by model")
def confusion_wide(fx):
    return M.confusion_wide(fx.preds, ["model"]).select("model", *[f"c_{i}_{j}" for i in K.GRADES for j in K.GRADES])


@query("h02_per_class", "preds", f"""with {CONFUSION}, {METRICS}
select model, label, round(prec,6) as "precision", round(rec,6) as recall, round(f1,6) as f1, sup as support, tp as correct from pc""")
def per_class(fx):
    return tidy(M.per_class(M.confusion_wide(fx.preds, ["model"]), ["model"]))


SUMMARY_OUT = """select model, n_rows, round(accuracy,6) as accuracy, round(balanced_accuracy,6) as balanced_accuracy,
  round(macro_precision,6) as macro_precision, round(macro_recall,6) as macro_recall, round(macro_f1,6) as macro_f1,
  round(weighted_f1,6) as weighted_f1, round(cohen_kappa,6) as cohen_kappa, round(quadratic_kappa,6) as quadratic_kappa,
  round(mean_abs_error,6) as mean_abs_error, """ + ", ".join(
    f"round(class_{i}_recall,6) as class_{i}_recall" for i in range(5)) + " from summary"


@query("h03_summary_metrics", "preds", f"with {CONFUSION}, {METRICS} {SUMMARY_OUT}")
def summary_metrics(fx):
    return tidy(M.evaluate(fx.preds, ["model"]))


@query("h03_present_label_averages", "preds", f"""with {CONFUSION}, {METRICS}
select model, round(avg(prec),6) as macro_precision, round(avg(rec),6) as macro_recall, round(avg(f1),6) as macro_f1
from (select * from pc where sup>0) group by model""")
def present_label_averages(fx):
    metrics = M.evaluate(fx.preds, ["model"], only_present=True)
    return tidy(metrics.select("model", "macro_precision", "macro_recall", "macro_f1"))


@query("h03_binary_averages", "preds", """
with b as (select model, sum(case when y_true>=2 and y_pred>=2 then 1 else 0 end)::bigint as tp,
  sum(case when y_true<2 and y_pred>=2 then 1 else 0 end)::bigint as fp,
  sum(case when y_true>=2 and y_pred<2 then 1 else 0 end)::bigint as fn,
  sum(case when y_true<2 and y_pred<2 then 1 else 0 end)::bigint as tn from preds group by model)
select model, tp+fp+fn+tn as n_rows, round((tp+tn)::double/(tp+fp+fn+tn),6) as accuracy,
  round((tp::double/(tp+fn)+tn::double/(tn+fp))/2,6) as balanced_accuracy, round(tp::double/(tp+fp),6) as "precision",
  round(tp::double/(tp+fn),6) as recall, round(2.0*tp/(2*tp+fp+fn),6) as f1, round(tn::double/(tn+fp),6) as negative_recall,
  fn as false_negatives, fp as false_positives from b""")
def binary_averages(fx):
    return tidy(M.binary_from_grades(fx.preds, ["model"]))


@query("h04_accuracy", "preds", """
select model, round(avg(case when y_true=y_pred then 1.0::double else 0.0::double end),6) as accuracy,
  (select round(avg(r),6) from (select y_true, avg(case when q.y_true=q.y_pred then 1.0::double else 0.0::double end) as r
     from preds q where q.model=p.model group by y_true)) as balanced_accuracy from preds p group by model""")
def accuracies(fx):
    return tidy(M.evaluate(fx.preds, ["model"]).select("model", "accuracy", "balanced_accuracy"))


@query("h05_kappa", "preds", f"""with {CONFUSION}, {METRICS}
select model, round(k1,6) as cohen_kappa, round(k2,6) as quadratic_kappa from kap""")
def kappas(fx):
    return tidy(M.evaluate(fx.preds, ["model"]).select("model", "cohen_kappa", "quadratic_kappa"))


@query("h06_mean_abs_error", "preds",
       "select model, round(avg(abs(y_true-y_pred)),6) as mean_abs_error from preds group by model")
def mean_abs_error(fx):
    return tidy(M.evaluate(fx.preds, ["model"]).select("model", "mean_abs_error"))


@query("h07_one_vs_rest", "preds", f"""with {CONFUSION}
select model, k as label,
  round(sum(case when y_true=k and y_pred=k then n else 0 end)::double/greatest(sum(case when y_true=k then n else 0 end),1),6) as sensitivity,
  round(sum(case when y_true<>k and y_pred<>k then n else 0 end)::double/greatest(sum(case when y_true<>k then n else 0 end),1),6) as specificity
from conf cross join lab group by model, k""")
def one_vs_rest(fx):
    return tidy(M.one_vs_rest(M.confusion_wide(fx.preds, ["model"]), ["model"]))


@query("h08_roc_auc", "preds", f"with {AUC} select model, n_pos, n_neg, round(auc,6) as auc from aucs")
def roc_auc(fx):
    return tidy(M.auc(fx.preds, ["model"], "score", positive()))


@query("h08_null_models", "preds_gaps", f"with {AUC.replace('from preds', 'from preds_gaps')} select model, n_pos, n_neg, round(auc,6) as auc from aucs")
def roc_auc_null_models(fx):
    return tidy(M.auc(fx.preds_gaps, ["model"], "score", positive()))


@query("h10_null_models", "preds_gaps", """
with d as (select model, score, sum((y_true>=2)::int)::bigint as pos, sum((y_true<2)::int)::bigint as neg from preds_gaps group by all),
w as (select *, sum(pos) over (partition by model order by score desc)::bigint as tp, sum(neg) over (partition by model order by score desc)::bigint as fp,
  sum(pos) over (partition by model)::double as p, sum(neg) over (partition by model)::double as n from d)
select model, score, tp, fp, round(tp/p,6) as tpr, round(fp/n,6) as fpr from w""")
def roc_points_null_models(fx):
    return tidy(M.roc_points(fx.preds_gaps, ["model"], "score", positive()))


@query("h09_macro_auc", "predictions", f"""with {LABELS},
lng as (select model, k, y_true=k as y, prob[k+1] as p from predictions cross join lab),
rk as (select model, k, y, rank() over (partition by model,k order by p) + (count(*) over (partition by model,k,p)-1)/2.0::double as r from lng),
a as (select model, k, sum(case when y then 1 else 0 end)::double as np, sum(case when y then 0 else 1 end)::double as nn,
  sum(case when y then r else 0 end) as s from rk group by all)
select model, round(avg((s-np*(np+1)/2)/(np*nn)),6) as macro_auc from a where np>0 group by model""")
def macro_auc(fx):
    return tidy(M.macro_auc(fx.predictions, ["model"]))


@query("h10_roc_points", "predictions", f"""with {LABELS},
lng as (select model, k as label, prob[k+1] as score, (y_true=k)::int as y from predictions cross join lab),
d as (select model, label, score, sum(y)::bigint as pos, sum(1-y)::bigint as neg from lng group by all),
w as (select *, sum(pos) over (partition by model,label order by score desc)::bigint as tp,
  sum(neg) over (partition by model,label order by score desc)::bigint as fp,
  sum(pos) over (partition by model,label)::double as p, sum(neg) over (partition by model,label)::double as n from d)
select model, label, round(score,6) as score, tp, fp, round(tp/p,6) as tpr, round(fp/n,6) as fpr from w""")
def roc_points(fx):
    long = M.long_probabilities(fx.predictions, ["model"])
    return tidy(M.roc_points(long, ["model", "label"], "p", F.col("hit")))


@query("h11_brier", "predictions", """
select model, round(avg(pow(score-(y_true>=2)::int,2)),6) as brier_binary,
  round(avg(list_sum(list_transform(range(0,5), lambda k: pow(prob[k+1]-(y_true=k)::int,2)))),6) as brier_multiclass
from predictions group by model""")
def brier(fx):
    return tidy(M.brier(fx.predictions, ["model"], "score", positive()))


SWEEP_COLUMNS = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "negative_recall", "uncertain_below_060",
                 *[M.band_column(lo, hi) for lo, hi in K.UNCERTAINTY_BANDS]]
SWEEP_OUT = ", ".join(f'round("{c}",6) as "{c}"' for c in SWEEP_COLUMNS)


@query("h12_threshold_sweep", "preds", f"""with {swept_sql(K.THRESHOLDS_STUDY)}, {AUC}
select model, threshold, {SWEEP_OUT}, false_negatives, false_positives, round(auc,6) as auc from sweep join aucs using (model)""")
def threshold_sweep(fx):
    return tidy(M.threshold_sweep(fx.preds, ["model"], "score", positive(), K.THRESHOLDS_STUDY))


@query("h12_null_models", "preds_gaps", f"""with {swept_sql(K.THRESHOLDS_STUDY, 'preds_gaps')}, {AUC.replace('from preds', 'from preds_gaps')}
select sweep.model, threshold, {SWEEP_OUT}, false_negatives, false_positives, round(auc,6) as auc from sweep join aucs on sweep.model is not distinct from aucs.model""")
def sweep_null_models(fx):
    return tidy(M.threshold_sweep(fx.preds_gaps, ["model"], "score", positive(), K.THRESHOLDS_STUDY))


def rule_sql(rule: str, order: str) -> str:
    return (f"select * from (select model, '{rule}' as rule, threshold, recall, f1, balanced_accuracy, false_negatives, "
            f"false_positives, row_number() over (partition by model order by {order}, threshold) as rn from sweep) where rn=1")


RULES = {
    "recall_first": "recall desc, f1 desc, false_negatives, false_positives",
    "target_recall_then_f1": f"(recall>={K.TARGET_RECALL!r})::int desc, f1 desc, balanced_accuracy desc, false_positives",
    "production_recall": "(recall>=0.9373)::int desc, recall desc, balanced_accuracy desc, f1 desc, false_negatives, false_positives",
    "fewest_misses": "(recall>=0.9646)::int desc, false_negatives, balanced_accuracy desc, f1 desc, false_positives",
    "safety_filtered": """(recall>=0.9646 and false_negatives<=56 and false_positives<=900)::int desc,
      case when recall>=0.9646 and false_negatives<=56 and false_positives<=900 then false_positives else 0 end,
      case when recall>=0.9646 then 0 else 1 end, false_negatives,
      case when recall>=0.9646 and false_negatives<=56 and false_positives<=900 then -recall else greatest(0,false_positives-900) end,
      balanced_accuracy desc, f1 desc""",
    "weighted_score": "(recall>=0.9665 and false_negatives<=53)::int desc, recall*2+balanced_accuracy-false_positives/10000.0::double desc",
    "high_recall": "recall desc",
    "balanced": "balanced_accuracy desc",
    "low_false_positives": "false_positives, f1 desc",
    "closest_to_baseline": f"abs(recall-{K.TARGET_RECALL!r}::double), abs(false_positives-398)",
}


@query("h13_operating_points", "preds", f"with {swept_sql(K.THRESHOLDS_EXPANDED)} "
       "select model, rule, threshold, round(recall,6) as recall, round(f1,6) as f1, "
       "round(balanced_accuracy,6) as balanced_accuracy, false_negatives, false_positives from ("
       + " union all ".join(rule_sql(rule, order) for rule, order in RULES.items()) + ")")
def operating_points(fx):
    sweep = M.threshold_sweep(fx.preds, ["model"], "score", positive(), K.THRESHOLDS_EXPANDED, with_auc=False)
    chosen = L.operating_points(sweep, ["model"])
    return tidy(chosen.select("model", "rule", "threshold", "recall", "f1", "balanced_accuracy",
                              "false_negatives", "false_positives"))


BY_SOURCE = f"""{LABELS}, conf as (select m.model, m.source, a.k as y_true, b.k as y_pred, count(p.row_id) as n
  from (select model, source from preds group by all having count(*)>=5) m cross join lab a cross join lab b
  left join preds p on p.model=m.model and p.source=m.source and p.y_true=a.k and p.y_pred=b.k group by all),
pc as (select * from {per_class_sql('conf', 'model, source')})"""


@query("h14_metrics_per_source", "preds", f"""with {BY_SOURCE}
select model, source, sum(sup)::bigint as n_rows, round(sum(tp)::double/sum(sup),6) as accuracy,
  round(avg(case when sup>0 then tp::double/sup end),6) as balanced_accuracy,
  round(avg(case when sup+prd=0 then 0 else 2.0*tp/(sup+prd) end),6) as macro_f1 from pc group by model, source""")
def metrics_per_source(fx):
    metrics = M.evaluate(fx.preds, ["model", "source"]).filter("n_rows >= 5")
    return tidy(metrics.select("model", "source", "n_rows", "accuracy", "balanced_accuracy", "macro_f1"))


@query("h15_misclassified", "predictions", """
select row_id, model, y_true, y_pred, round(prob[y_pred+1],6) as probability, round(list_max(prob),6) as confidence_score,
  """ + ", ".join(f"round(prob[{k + 1}],6) as probability_class_{k}" for k in range(5)) + " from predictions where y_true<>y_pred")
def misclassified(fx):
    wrong = fx.predictions.filter("y_true <> y_pred")
    return tidy(wrong.select(
        "row_id", "model", "y_true", "y_pred", F.element_at("prob", F.col("y_pred") + 1).alias("probability"),
        F.array_max("prob").alias("confidence_score"),
        *[F.col("prob")[k].alias(f"probability_class_{k}") for k in K.GRADES]))


@query("h16_minority_recall", "preds", f"""with {CONFUSION}, {METRICS},
med as (select model, quantile_cont(sup,0.5) as m from pc where sup>0 group by model)
select model, round(avg(rec),6) as minority_recall from pc join med using (model) where sup>0 and sup<=m group by model""")
def minority_recall(fx):
    classes = M.per_class(M.confusion_wide(fx.preds, ["model"]), ["model"]).filter("support > 0")
    medians = classes.groupBy("model").agg(F.percentile("support", 0.5).alias("m"))
    low = classes.join(medians, "model").filter("support <= m")
    return tidy(low.groupBy("model").agg(F.avg("recall").alias("minority_recall")))


@query("h17_selection_scores", "preds", f"""with {CONFUSION}, {METRICS},
b as (select model, sum(case when y_true>=2 and y_pred>=2 then 1 else 0 end)::double as tp,
  sum(case when y_true<2 and y_pred>=2 then 1 else 0 end)::double as fp, sum(case when y_true>=2 and y_pred<2 then 1 else 0 end)::double as fn,
  sum(case when y_true<2 and y_pred<2 then 1 else 0 end)::double as tn from preds group by model)
select model, round(0.30*macro_f1+0.25*balanced_accuracy+0.15*class_3_recall+0.10*class_1_recall+0.10*class_4_recall
    +0.10*least(class_0_recall,class_2_recall),6) as grading_score,
  round(0.45*tp/(tp+fn)+0.25*(tp/(tp+fn)+tn/(tn+fp))/2+0.20*2*tp/(2*tp+fp+fn)-0.10*(fn/greatest(tp+fn,1)),6) as binary_score
from summary join b using (model)""")
def selection_scores(fx):
    grading = M.evaluate(fx.preds, ["model"]).select("model", L.grading_score().alias("grading_score"))
    binary = M.binary_from_grades(fx.preds, ["model"])
    positives = fx.preds.groupBy("model").agg(F.count_if(positive()).alias("n_pos"))
    scored = binary.join(positives, "model").select("model", L.binary_score(F.col("n_pos")).alias("binary_score"))
    return tidy(grading.join(scored, "model"))


@query("h18_promotion_gates", "preds", f"""with {CONFUSION}, {METRICS}
select model, (macro_f1>0.5718 or balanced_accuracy>0.6083 or accuracy>=0.6602+0.02) as improves,
  (class_3_recall>=0.64 and class_1_recall>=0.4533-0.05 and class_4_recall>=0.6233-0.05) as safe_classes,
  improves and safe_classes as replace_grading,
  ((macro_f1>0.5077 or balanced_accuracy>0.5312) and class_3_recall>0.3095 and class_0_recall>=0.70 and class_2_recall>=0.45) as beats_production,
  (macro_f1>0.5799 and balanced_accuracy>0.6113 and class_3_recall>=0.64) as report_gate from summary""")
def promotion_gates(fx):
    metrics = M.evaluate(fx.preds, ["model"])
    return metrics.select("model", *[c.alias(name) for name, c in L.grading_gates().items()])


@query("h18_screening_gates", "preds", f"""with {swept_sql(K.THRESHOLDS_EXPANDED)}
select model, threshold, (recall>=0.9646 and false_negatives<=56 and false_positives<=900 and uncertain_025_075<=0.35) as replace_screening,
  (recall>=0.9373 and false_negatives<=88) as beats_production, (recall>=0.9665 and false_negatives<=53 and false_positives<900) as report_gate
from sweep""")
def screening_gates(fx):
    sweep = M.threshold_sweep(fx.preds, ["model"], "score", positive(), K.THRESHOLDS_EXPANDED, with_auc=False)
    return sweep.select("model", "threshold", *[c.alias(name) for name, c in L.screening_gates().items()])


@query("h19_positive_recall_from_grades", "preds", """
select model, round(sum(case when y_true>=2 and y_pred>=2 then 1 else 0 end)::double/sum(case when y_true>=2 then 1 else 0 end),6) as recall,
  sum(case when y_true>=2 and y_pred<2 then 1 else 0 end)::bigint as false_negatives from preds group by model""")
def positive_recall_from_grades(fx):
    return tidy(M.binary_from_grades(fx.preds, ["model"]).select("model", "recall", "false_negatives"))


SEARCH_GRIDS = [[0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0], [1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9, 2.0],
                [2.1, 2.2, 2.3, 2.4, 2.5, 2.6, 2.7, 2.8, 2.9, 3.0], [3.1, 3.2, 3.3, 3.4, 3.5, 3.6, 3.7, 3.8]]


@query("h20_optimised_cuts")
def optimised_cuts(fx):
    graded = fx.preds.select("model", "y_true", (F.col("score") * 4).alias("value"))
    return tidy(M.optimise_cuts(graded, ["model"], "value", "y_true", K.CUTS_ADJUSTED, SEARCH_GRIDS, passes=2))


CUT_SETS = {"default": K.CUTS_DEFAULT, "adjusted": K.CUTS_ADJUSTED, "regression": K.CUTS_REGRESSION}


def cuts_sql(name, cuts) -> str:
    grade = "+".join(f"(score*4>{c})::int" for c in cuts)
    return f"select model || ' {name}' as model, row_id, y_true, least({grade},4) as y_pred from preds"


@query("h21_cut_set_comparison", "preds", f"""with graded as ({' union all '.join(cuts_sql(n, c) for n, c in CUT_SETS.items())}),
{CONFUSION.replace('preds', 'graded')}, {METRICS}
select split_part(model,' ',1) as model, split_part(model,' ',2) as cut_set, round(macro_f1,6) as macro_f1,
  round(balanced_accuracy,6) as balanced_accuracy, round(quadratic_kappa,6) as quadratic_kappa from summary""")
def cut_set_comparison(fx):
    graded = fx.preds.withColumn("value", F.col("score") * 4)
    table = M.compare_cut_sets(graded, ["model"], "value", "y_true", CUT_SETS)
    return tidy(table.select("model", "cut_set", "macro_f1", "balanced_accuracy", "quadratic_kappa"))


@query("h22_before_after_submodel", "preds", """
with j as (select a.y_true, a.y_pred as before_pred,
    case when a.y_pred in (3,4) then (case when b.score>=0.5 then 4 else 3 end) else a.y_pred end as after_pred
  from preds a join preds b on a.row_id=b.row_id and a.model='m1' and b.model='m2'),
l as (select 'before' as stage, y_true, before_pred as p from j union all select 'after', y_true, after_pred from j),
c as (select stage, sum(case when y_true=3 and p=3 then 1 else 0 end)::bigint as c_3_3, sum(case when y_true=3 and p=4 then 1 else 0 end)::bigint as c_3_4,
    sum(case when y_true=4 and p=3 then 1 else 0 end)::bigint as c_4_3, sum(case when y_true=4 and p=4 then 1 else 0 end)::bigint as c_4_4,
    sum(case when y_true=p then 1 else 0 end)::double/count(*) as accuracy from l group by stage)
select stage, c_3_3, c_3_4, c_4_3, c_4_4, round(accuracy,6) as accuracy,
  (select x.c_3_4+x.c_4_3 < y.c_3_4+y.c_4_3 from c x, c y where x.stage='after' and y.stage='before') as reduced_confusion from c""")
def before_after_submodel(fx):
    main = fx.preds.filter("model = 'm1'").select("row_id", "y_true", "y_pred")
    sub = fx.preds.filter("model = 'm2'").select("row_id", F.when(F.col("score") >= 0.5, 4).otherwise(3).alias("sub"))
    after = F.when(F.col("y_pred").isin(3, 4), F.col("sub")).otherwise(F.col("y_pred"))
    stages = main.join(sub, "row_id").select("y_true", F.inline(F.array(
        F.struct(F.lit("before").alias("stage"), F.col("y_pred").alias("y_pred")),
        F.struct(F.lit("after").alias("stage"), after.alias("y_pred")))))
    wide = M.confusion_wide(stages, ["stage"]).select(
        "stage", "c_3_3", "c_3_4", "c_4_3", "c_4_4", M.accuracy(K.GRADES).alias("accuracy"))
    confused = F.col("c_3_4") + F.col("c_4_3")
    verdict = wide.agg((F.max(F.when(F.col("stage") == "after", confused))
                        < F.max(F.when(F.col("stage") == "before", confused))).alias("reduced_confusion"))
    return tidy(wide.crossJoin(F.broadcast(verdict)))


@query("h23_route_agreement", "preds", """
select a.source, count(*) as n_rows, round(avg((a.y_pred=b.y_pred)::int),6) as agreement
from preds a join preds b on a.row_id=b.row_id and a.model='m1' and b.model='m2' group by a.source""")
def route_agreement(fx):
    # Both routes of an item are brought together by one aggregation on the item, not by a self-join.
    def route(m):
        return F.max(F.when(F.col("model") == m, F.col("y_pred")))

    paired = fx.preds.groupBy("row_id", "source").agg(route("m1").alias("a"), route("m2").alias("b"))
    both = paired.filter("a is not null and b is not null")
    return tidy(both.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement")))


@query("h24_system_comparison", "preds", f"""with {CONFUSION}, {METRICS}, {swept_sql([0.5])},
u as (select model, 'grading' as task, accuracy, balanced_accuracy, macro_f1, null::double as recall, null::bigint as false_negatives from summary
  union all select model, 'screening', accuracy, balanced_accuracy, null, recall, false_negatives from sweep)
select model, task, round(accuracy,6) as accuracy, round(balanced_accuracy,6) as balanced_accuracy, round(macro_f1,6) as macro_f1,
  round(recall,6) as recall, false_negatives,
  round(accuracy-(select accuracy from u where model='m1' and task='grading'),6) as accuracy_delta,
  round(balanced_accuracy-(select balanced_accuracy from u where model='m1' and task='grading'),6) as balanced_accuracy_delta from u""")
def system_comparison(fx):
    grading = M.evaluate(fx.preds, ["model"]).select(
        "model", F.lit("grading").alias("task"), "accuracy", "balanced_accuracy", "macro_f1")
    screening = M.threshold_sweep(fx.preds, ["model"], "score", positive(), [0.5], with_auc=False).select(
        "model", F.lit("screening").alias("task"), "accuracy", "balanced_accuracy", "recall", "false_negatives")
    table = grading.unionByName(screening, allowMissingColumns=True)
    baseline = grading.filter("model = 'm1'")
    return tidy(L.delta_to_baseline(table, baseline, ["accuracy", "balanced_accuracy"]))


@query("h25_flatten_metric_json", "preds", f"""with {CONFUSION}, {METRICS}
select model, label, round(rec,6) as recall, sup as support from pc""")
def flatten_metric_json(fx):
    """Metric documents (a map per class) written and flattened again: one row per model and class."""
    classes = M.per_class(M.confusion_wide(fx.preds, ["model"]), ["model"])
    documents = classes.groupBy("model").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(
        F.col("label").cast("string"), F.struct("recall", "support")))).alias("per_class"))).alias("doc"))
    from gradewell.operators.reports import flatten_classes
    return tidy(flatten_classes(documents, "doc", ["model"]))


@query("h26_prediction_export", "preds", """
select row_id, model, source, y_true, y_pred, round(score,6) as score, round(least(greatest(score*5/4,0),1),6) as binary_score,
  (y_true>=2)::int as true_positive_grade, (y_pred>=2)::int as pred_positive_grade from preds""")
def prediction_export(fx):
    from gradewell.operators.reports import export_predictions
    graded = fx.preds.withColumn("ordinal", F.col("score") * 5)
    return tidy(export_predictions(graded, "ordinal").drop("ordinal", *[f"w{k}" for k in range(5)]))


@query("f10_leaderboard", "preds", f"""with {CONFUSION}, {METRICS}
select model, row_number() over (order by macro_f1 desc, macro_recall desc, quadratic_kappa desc, model) as rank,
  round(macro_f1,6) as macro_f1 from summary""")
def leaderboard(fx):
    return tidy(L.leaderboard(M.evaluate(fx.preds, ["model"])).select("model", "rank", "macro_f1"))


def best_sql(rule: str, order: str) -> str:
    return f"select * from (select '{rule}' as rule, model, macro_f1, accuracy from summary order by {order}, model limit 1)"


@query("f11_best_models", "preds", f"with {CONFUSION}, {METRICS} select rule, model, round(macro_f1,6) as macro_f1, "
       "round(accuracy,6) as accuracy from (" + " union all ".join([
           best_sql("selection_score", "0.30*macro_f1+0.25*balanced_accuracy+0.15*class_3_recall+0.10*class_1_recall"
                    "+0.10*class_4_recall+0.10*least(class_0_recall,class_2_recall) desc"),
           best_sql("safe_then_macro_f1", "(class_3_recall>=0.64)::int desc, macro_f1 desc, balanced_accuracy desc, accuracy desc"),
           best_sql("macro_f1", "macro_f1 desc"),
           best_sql("report_score", "macro_f1*2+balanced_accuracy+class_3_recall*0.25 desc")]) + ")")
def best_models(fx):
    return tidy(L.best_models(M.evaluate(fx.preds, ["model"])).select("rule", "model", "macro_f1", "accuracy"))


@query("f12_top_confusions", "preds", f"""with {CONFUSION}
select * from (select model, y_true, y_pred, n, abs(y_true-y_pred) as distance,
  row_number() over (partition by model order by n desc, abs(y_true-y_pred) desc, y_true, y_pred) as rank
from conf where y_true<>y_pred and n>0) where rank<=10""")
def top_confusions(fx):
    counts = fx.preds.groupBy("model", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return L.confusion_pairs(counts, ["model"])


@query("f13_common_wrong_prediction", "preds", f"""with {CONFUSION}
select model, y_true, y_pred as wrong_pred, n from (select *, row_number() over (partition by model, y_true order by n desc, y_pred) as rn
from conf where y_true<>y_pred and n>0) where rn=1""")
def common_wrong_prediction(fx):
    counts = fx.preds.groupBy("model", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return L.most_common_wrong(counts, ["model"])
