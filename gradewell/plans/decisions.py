"""Queries for quality gates, decision rules and probability features."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.functions import decisions as D
from gradewell.functions import probability as PR
from gradewell.functions import quality as Q
from gradewell.operators.metrics import ordinal_grade
from gradewell.plans.registry import CATALOG
from gradewell.plans.tools import tidy

query = CATALOG.query


def taken(fx):
    """Events as images with capture metrics derived from the event value."""
    e, v = F.col("event_id"), F.col("value")
    return fx.table("events").select(
        "event_id", (e % 97 != 0).alias("readable"), (150 + e % 400).cast("int").alias("width"), (190 + e % 300).cast("int").alias("height"),
        (v / 4).alias("blur_score"), ((e * 7) % 256).cast("double").alias("brightness_mean"), ((e % 40) * 1.5).alias("contrast_std"),
        ((e % 100) / 100.0).alias("fundus_area_ratio"))


TAKEN = """taken as (select event_id, event_id%97<>0 as readable, (150+event_id%400)::int as width, (190+event_id%300)::int as height, value/4 as blur_score,
  ((event_id*7)%256)::double as brightness_mean, (event_id%40)*1.5::double as contrast_std, (event_id%100)/100.0::double as fundus_area_ratio from events)"""


@query("b12_simple_quality_flags", "", f"""with {TAKEN},
f as (select event_id, readable, list_filter([case when width<200 or height<200 then 'image_too_small' end, case when blur_score<8 then 'blurry' end,
  case when brightness_mean<12 then 'too_dark' end, case when brightness_mean>245 then 'too_bright' end, case when contrast_std<5 then 'low_contrast' end], lambda x: x is not null) as fl from taken)
select event_id, case when not readable then 'unreadable' when len(fl)=0 then 'acceptable' else array_to_string(fl,';') end as status, readable and len(fl)=0 as quality_pass from f""")
def simple_quality_flags(fx):
    table = taken(fx).withColumn("flags", Q.simple_flags(*[F.col(c) for c in ("width", "height", "blur_score", "brightness_mean", "contrast_std")]))
    return table.select("event_id", Q.simple_status(F.col("flags"), F.col("readable")).alias("status"),
                        (F.col("readable") & (F.size("flags") == 0)).alias("quality_pass"))


GATE = f"""{TAKEN},
bl as (select *, [case when blur_score<6 then 'Image is too blurry for screening support.' end, case when brightness_mean<20 then 'Image is too dark for screening support.' end,
    case when brightness_mean>240 then 'Image is too bright for screening support.' end, case when contrast_std<5 then 'Image contrast is too low for screening support.' end,
    case when fundus_area_ratio<0.025 then 'Detected retinal field is too small.' end] as b,
  [case when blur_score>=6 and blur_score<45 then 'Image may be blurry.' end, case when brightness_mean>=20 and brightness_mean<35 then 'Image may be underexposed.' end,
    case when brightness_mean<=240 and brightness_mean>220 then 'Image may be overexposed.' end, case when contrast_std>=5 and contrast_std<12 then 'Image contrast may be too low.' end,
    case when fundus_area_ratio>=0.025 and fundus_area_ratio<0.08 then 'Detected retinal field is too small.' end] as w from taken),
c as (select *, list_filter(b, lambda x: x is not null) as bb, list_filter(w, lambda x: x is not null) as ww from bl),
s as (select *, len(bb) as nb, greatest(0, least(100, 22*least(greatest(blur_score/90,0),1)+14*least(greatest(sqrt(greatest(blur_score,0))/14,0),1)
    +20*(1-least(abs(brightness_mean-115)/115,1))+18*least(greatest(contrast_std/45,0),1)
    +10*(1-least(abs(brightness_mean/greatest(contrast_std,1)-4)/8,1))+16*least(greatest(fundus_area_ratio/0.55::double,0),1)-18*len(bb))) as raw from c),
gate as (select event_id, array_to_string(list_concat(bb,ww),'|') as warnings, nb::int as n_blocking, round_even(raw,0)::int as quality_score from s)"""


def gated(fx):
    table = taken(fx)
    metrics = {c: F.col(c) for c in ("blur_score", "brightness_mean", "contrast_std", "fundus_area_ratio")}
    return table.select("event_id", *[c.alias(n) for n, c in Q.two_level_gate(metrics).items()])


@query("b13_quality_gate", "", f"""with {GATE} select *, case when quality_score>=80 then 'Good' when quality_score>=50 then 'Acceptable' else 'Poor' end as quality_label,
  n_blocking=0 and quality_score>=50 as is_acceptable from gate""")
def quality_gate(fx):
    return gated(fx).withColumn("warnings", F.array_join("warnings", "|"))


FIELD = """fld as (select event_id, (event_id%101)/100.0::double as area, (event_id%53)/52.0::double as circ, (event_id%47)/46.0::double as ext, event_id%3=0 as touch,
  (event_id%30)::double as sat, (event_id%61-40)::double as ro, (event_id%16)::double as tex, (event_id%20)/10000.0::double as hint from events)"""


@query("b13_field_rules", "", f"""with {FIELD}, x as (select *, area>0.80 and ext>0.88 as ff, not (sat>=8 and ro>=-25) and hint<0.001 and tex<8 as odd from fld)
select event_id, array_to_string(list_filter([case when area>0.94 then 'Retinal field fills most of the image.' when touch and area>0.72 then 'Retinal field boundary could not be separated from background.' end,
    case when circ>=0.20 and circ<0.38 and not ff then 'Detected retinal field is not round enough.' end,
    case when not odd and (sat<18 or ro<-5) then 'Image does not match expected retinal color.' end, case when hint<0.0004 then 'Retinal vessel pattern is weak.' end], lambda v: v is not null),'|') as warnings,
  array_to_string(list_filter([case when circ<0.20 and not ff then 'Detected retinal field is not round enough.' end, case when odd then 'Image does not match expected retinal color.' end], lambda v: v is not null),'|') as blocking from x""")
def field_rules(fx):
    e = F.col("event_id")
    w, b = Q.field_warnings((e % 101) / 100.0, (e % 53) / 52.0, (e % 47) / 46.0, e % 3 == 0, (e % 30).cast("double"),
                            (e % 61 - 40).cast("double"), (e % 16).cast("double"), (e % 20) / 10000.0)
    return fx.table("events").select("event_id", F.array_join(w, "|").alias("warnings"), F.array_join(b, "|").alias("blocking"))


@query("b14_quality_status", "", f"""with {GATE}, l as (select *, lower(replace(warnings,'|',' ')) as j from gate)
select event_id, case when n_blocking=0 and quality_score>=50 then 'acceptable' else 'poor' end as overall,
  case when j like '%blur%' then 'needs_retake' else 'acceptable' end as blur,
  case when j like '%dark%' or j like '%underexposed%' then 'too_dark' when j like '%bright%' or j like '%overexposed%' then 'too_bright' else 'acceptable' end as brightness,
  case when j like '%contrast%' then 'too_low' else 'acceptable' end as contrast,
  array_to_string(list_filter([case when j like '%blur%' then 'Image too blurry. Please retake the image.' end,
    case when j like '%retinal field%' or j like '%round enough%' then 'Retina not fully visible.' end,
    case when j like '%dark%' or j like '%bright%' or j like '%exposed%' or j like '%contrast%' then 'Poor lighting detected.' end,
    case when j like '%too small%' or j like '%boundary%' then 'Fundus coverage insufficient.' end], lambda v: v is not null),'|') as advice from l""")
def quality_status(fx):
    summary = Q.status_summary(F.col("warnings"), F.col("is_acceptable"))
    return gated(fx).select("event_id", *[c.alias(n) for n, c in summary.items()],
                            F.array_join(Q.retake_advice(F.col("warnings")), "|").alias("advice"))


FOUND = """found as (select row_id, label, (row_id%18)::int as ma, (row_id%5)::int as ex, (row_id%3)::int as qu, (row_id%20)/100.0::double as vd, (row_id%7)*100.0::double as gc, (row_id%11)/10.0::double as ai from feats)"""


def found(fx):
    k = F.col("row_id")
    return fx.feats.select(
        "row_id", "label", (k % 18).cast("int").alias("ma_count"), (k % 5).cast("int").alias("exudate_count"), (k % 3).cast("int").alias("exudate_quadrants"),
        ((k % 20) / 100.0).alias("vessel_density"), ((k % 7) * 100.0).alias("glcm_contrast"), ((k % 11) / 10.0).alias("pathology_area_index"))


@query("b15_rule_grade", "feats", f"""with {FOUND}
select row_id, case when vd>0.12 and gc>500 then 4 when ma=0 and ex=0 then 0 when ma>15 or qu>=2 then 3 when ma between 1 and 5 and ex=0 then 1
  when ma between 6 and 15 or (ex>0 and qu=1) then 2 else 1 end as grade from found""")
def rule_grade(fx):
    grade, _ = D.rule_grade(*[F.col(c) for c in ("ma_count", "exudate_count", "exudate_quadrants", "vessel_density", "glcm_contrast")])
    return found(fx).select("row_id", grade.alias("grade"))


@query("b16_score_grade", "feats", f"""with {FOUND}, s as (select *, ma*1.0::double+ex*1.4::double+qu*5.0::double+ai*14.0::double+vd*100.0::double*0.2::double+gc*0.02::double as sc from found)
select row_id, round(sc,6) as score, case when sc>=42 and vd>=0.12 and gc>=500 then 4 when ma+ex=0 and sc<1 then 0 when sc>=18 then 3 when sc>=8 then 2 when sc>=1 or ma+ex>0 then 1 else 0 end as grade from s""")
def score_grade(fx):
    params = D.literal_params(D.ScoreParams())
    findings = {c: F.col(c) for c in ("ma_count", "exudate_count", "exudate_quadrants", "vessel_density", "glcm_contrast", "pathology_area_index")}
    return tidy(found(fx).select("row_id", D.weighted_score(findings, params).alias("score"), D.score_grade(findings, params).alias("grade")))


@query("b17_reconciliation", "shots", """
with d as (select event_id, p_ref>=0.5 as b, grade from shots where quality_ok)
select event_id, case when b<>(grade>=2) then case when grade>=2 then 'severity_escalation' else 'screening_severity_disagreement' end else 'aligned' end as status,
  (b<>(grade>=2)) or b as positive, case when b<>(grade>=2) then 'referable_review' when b then 'referable' else 'non_referable' end as result,
  case when b<>(grade>=2) then 'Referable / Needs ophthalmologist review' when b then 'Referable DR' else 'Non-referable DR' end as label from d""")
def reconciliation(fx):
    rows = fx.shots.filter("quality_ok")
    decided = D.reconcile(F.col("p_ref") >= 0.5, F.col("grade"))
    return rows.select("event_id", *[c.alias(n) for n, c in decided.items()])


SCREENED = """scr as (select event_id, user_id, session_id, ts, quality_ok, event_id%29<>0 as available, p_ref, grade, greatest(p_ref,1-p_ref) as conf, (p_ref>=0.5)=(grade>=2) as aligned, p_ref>=0.5 as pos from shots),
screen as (select *, case when not quality_ok then 'uncertain' when not available then 'uncertain' when not aligned then 'referable_review' when conf<0.6 then 'uncertain' when pos then 'referable' else 'non_referable' end as result from scr)"""


def screened(fx):
    """Events with the screening result fields."""
    p = F.col("p_ref")
    fields = D.screening_result(F.col("quality_ok"), F.col("event_id") % 29 != 0, (p >= 0.5) == (F.col("grade") >= 2), p >= 0.5, p)
    return fx.shots.select("event_id", "user_id", "session_id", "ts", "quality_ok", "grade", *[c.alias(n) for n, c in fields.items()])


@query("b18_screening_result", "shots", f"""with {SCREENED}
select event_id, result, case when not quality_ok then 'Uncertain screening result' when not available then 'Analysis models unavailable' when not aligned then 'Referable / Needs ophthalmologist review'
  when conf<0.6 then 'Uncertain screening result' when pos then 'Referable DR' else 'Non-referable DR' end as label,
  round(case when quality_ok and available then conf end,6) as confidence, case when quality_ok and available and conf>=0.8 then 'high' when quality_ok and available and conf>=0.6 then 'medium' else 'low' end as confidence_level,
  round(case when quality_ok and available then p_ref end,6) as positive_probability, round(case when quality_ok and available then 1-p_ref end,6) as negative_probability from screen""")
def screening_result(fx):
    return tidy(screened(fx).drop("user_id", "session_id", "ts", "quality_ok", "grade"))


@query("b19_confidence_tiers", "shots", """
select event_id, case when p_ref>=0.8 then 'high' when p_ref>=0.6 then 'medium' else 'low' end as tier,
  case when p_ref is null then 'Medium Confidence' when p_ref>=0.75 then 'High Confidence' when p_ref>=0.45 then 'Medium Confidence' else 'Low Confidence' end as label from shots""")
def confidence_tiers(fx):
    return fx.shots.select("event_id", D.confidence_tier(F.col("p_ref")).alias("tier"), D.confidence_label(F.col("p_ref")).alias("label"))


@query("b20_probability_features", "predictions", """
select row_id, model, list_position(prob, list_max(prob))::int-1 as predicted_class, round(list_max(prob),6) as max_probability, round(1-list_max(prob),6) as uncertainty,
  round(list_sum(list_transform(prob, lambda p: -p*ln(greatest(p,1e-9::double)))),6) as entropy, round(list_reverse_sort(prob)[1]-list_reverse_sort(prob)[2],6) as margin,
  round(prob[2]+2*prob[3]+3*prob[4]+4*prob[5],6) as expected_grade, round(prob[3]+prob[4]+prob[5],6) as positive_probability from predictions""")
def probability_features(fx):
    return tidy(fx.predictions.select("row_id", "model", *[c.alias(n) for n, c in PR.prediction_features(F.col("prob")).items()]))


SOFT = """v as (select row_id, model, score*4 as v from preds),
a as (select row_id, model, v, list_transform([0,1,2,3,4], lambda c: exp(-abs(c-v))) as e1, list_transform([0,1,2,3,4], lambda c: exp(-pow(c-v,2))) as e2 from v)"""


@query("b21_soft_classes", "preds", f"with {SOFT} select row_id, model, " + ", ".join(
    f"round(e1[{k + 1}]/list_sum(e1),6) as p{k}, round(e2[{k + 1}]/list_sum(e2),6) as q{k}" for k in range(5))
    + ", round(1/(1+exp(-(v-1.6::double))),6) as positive_score from a")
def soft_classes(fx):
    v = F.col("score") * 4
    both = fx.preds.select("row_id", "model", PR.soft_classes(v).alias("p"), PR.soft_classes(v, squared=True).alias("q"),
                           PR.logistic_score(v, K.CUTS_REGRESSION[1]).alias("positive_score"))
    return tidy(both.select("row_id", "model", *[F.col(c)[k].alias(f"{c}{k}") for c in "pq" for k in K.GRADES], "positive_score"))


@query("b22_ordinal_grades", "preds", """
select row_id, model, (score*4>0.5)::int+(score*4>1.5)::int+(score*4>2.5)::int+(score*4>3.5)::int as default_grade,
  (score*4>1.0)::int+(score*4>1.6)::int+(score*4>2.1)::int+(score*4>3.1)::int as regression_grade from preds""")
def ordinal_grades(fx):
    v = F.col("score") * 4
    return fx.preds.select("row_id", "model", ordinal_grade(v, K.CUTS_DEFAULT).alias("default_grade"),
                           ordinal_grade(v, K.CUTS_REGRESSION).alias("regression_grade"))


@query("b23_aligned_probabilities", "preds", """
with m as (select row_id, model, case when row_id%3=0 then 0 else w1 end as a1, w2 as a2, case when row_id%5=0 then 0 else w4 end as a4, row_id%7=0 as none from preds)
select row_id, model, 0.0::double as p0, round(case when none then 0 else a1/(a1+a2+a4) end,6) as p1, round(case when none then 0 else a2/(a1+a2+a4) end,6) as p2, 0.0::double as p3,
  round(case when none then 0 else a4/(a1+a2+a4) end,6) as p4 from m""")
def aligned_probabilities(fx):
    """Models that know only some of the classes, and rows without any probability."""
    k = F.col("row_id")
    known = F.map_filter(
        F.create_map(F.lit(1), "w1", F.lit(2), "w2", F.lit(4), "w4", F.lit(9), F.lit(5.0)),
        lambda c, p: ~((c == 1) & (k % 3 == 0)) & ~((c == 4) & (k % 5 == 0)) & ((k % 7 != 0) | (c == 9)))
    aligned = fx.preds.select("row_id", "model", PR.align(known).alias("p"))
    return tidy(aligned.select("row_id", "model", *[F.col("p")[i].alias(f"p{i}") for i in K.GRADES]))


@query("b24_decided_classes", "predictions", """
select row_id, model, (score>=0.35)::int as binary_class, list_position(prob, list_max(prob))::int-1 as grade from predictions""")
def decided_classes(fx):
    two = F.array(1 - F.col("score"), F.col("score"))
    return fx.predictions.select("row_id", "model", PR.decide(two, [0, 1], 0.35).alias("binary_class"), PR.decide(F.col("prob")).alias("grade"))


@query("b25_grade_scores", "preds", """
with s as (select row_id, model, y_pred, (row_id%40)/10.0::double as ai from preds)
select row_id, model, case when y_pred=0 then 0 else round_even(least(greatest((case y_pred when 1 then 25 when 2 then 55 when 3 then 80 when 4 then 95 else 0 end)+least(ai*2,4),0),99),1) end as score from s""")
def grade_scores(fx):
    return fx.preds.select("row_id", "model", D.grade_score(F.col("y_pred"), (F.col("row_id") % 40) / 10.0).alias("score"))


@query("b25_positive_percentage", "predictions", """
select row_id, model, case when row_id%4=0 then case when y_pred>=2 then case y_pred when 2 then 55.0 when 3 then 80.0 else 95.0 end else 0.0 end::double
  else round_even(least(greatest((prob[3]+prob[4]+prob[5])*100,0),100),1) end as pct from predictions""")
def positive_percentage(fx):
    prob = F.when(F.col("row_id") % 4 == 0, None).otherwise(F.col("prob"))
    return fx.predictions.select("row_id", "model", D.positive_percentage(F.col("y_pred"), prob).alias("pct"))


@query("b27_findings", "regions", """
with c as (select image_id, sum((kind='A')::int) as a, sum((kind='N')::int) as n, sum((kind='R')::int) as r from regions group by image_id)
select image_id, 4 as n_findings, array_to_string(list_filter([case when a>0 then 'Microaneurysms' end, case when n>0 then 'Hard Exudates' end, case when r*0.05::double>0.08 then 'Vessel Abnormalities' end,
  case when r>1 then 'Cotton Wool Spots' end], lambda x: x is not null),'|') as detected from c""")
def findings(fx):
    counts = fx.regions.groupBy("image_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in "ANR"])
    everything, detected = D.findings_list([
        ("Microaneurysms", F.col("A") > 0), ("Hard Exudates", F.col("N") > 0),
        ("Vessel Abnormalities", F.col("R") * 0.05 > 0.08), ("Cotton Wool Spots", F.col("R") > 1)])
    return counts.select("image_id", F.size(everything).alias("n_findings"), F.array_join(detected, "|").alias("detected"))


@query("b30_tiers", "shots", """
select event_id, case when grade is null then 'Unstageable' when grade>=2 then 'Referable' else 'Non-Referable' end as grade_status, coalesce(grade>=2,false) as grade_positive,
  case when grade is null then 'Quality gate failed' when grade>=2 then 'DR grades 2-4 are mapped to referable screening-support review.' else 'DR grades 0-1 are mapped to non-referable screening-support review.' end as grade_rule,
  case when p_ref>=0.5 then 'Referable' else 'Non-Referable' end as binary_status,
  'Binary screening model classified the case as ' || case when p_ref>=0.5 then 'referable' else 'non-referable' end || ' using optimized probability threshold ' ||
    case when event_id%2=0 then '0.20' else '0.35' end || '.' as binary_rule from shots""")
def tiers(fx):
    by_grade = D.grade_tier(F.col("grade"))
    threshold = F.when(F.col("event_id") % 2 == 1, F.lit(0.35))
    binary = D.binary_tier(F.coalesce(F.col("p_ref") >= 0.5, F.lit(False)), threshold)
    return fx.shots.select("event_id", *[c.alias(f"grade_{n}") for n, c in by_grade.items()],
                           binary["status"].alias("binary_status"), binary["rule"].alias("binary_rule"))


@query("m15_hierarchical_grades", "preds", """
with s as (select row_id, max(case when model='m1' then score end) as p1, max(case when model='m2' then score end) as p2, max(case when model='m1' then y_pred end) as sev, max(case when model='m2' then y_pred end) as other from preds group by row_id),
a as (select *, case when p1<0.5 then 0 when p2<0.5 then 1 else sev end as h1, case when sev=0 then 0 when sev=1 then least(other,1) else greatest(other,2) end as h2, case when sev=0 then 0 when sev=1 then 1 else greatest(other,2) end as b from s)
select row_id, case when h1 in (3,4) then case when other%2=1 then 4 else 3 end else h1 end as a_grade, b as b_grade, h1 as h1_grade, h2 as h2_grade from a""")
def hierarchical_grades(fx):
    def of(model, column):
        return F.max(F.when(F.col("model") == model, F.col(column)))

    stages = fx.preds.groupBy("row_id").agg(
        of("m1", "score").alias("p1"), of("m2", "score").alias("p2"), of("m1", "y_pred").alias("severity"), of("m2", "y_pred").alias("other"))
    sev, other = F.col("severity"), F.col("other")
    group = F.least(sev, F.lit(2))
    high, low = F.greatest(other, F.lit(2)), F.least(other, F.lit(1))
    return stages.select(
        "row_id", D.staged_grade(F.col("p1"), F.col("p2"), sev, other % 2).alias("a_grade"), D.grouped_grade(group, high).alias("b_grade"),
        D.staged_grade(F.col("p1"), F.col("p2"), sev).alias("h1_grade"), D.grouped_grade(group, high, low).alias("h2_grade"))


@query("m16_pair_corrections", "preds", """
with c as (select row_id, model, y_pred, row_id%2 as d1, row_id%3=1 as d2, row_id%5=1 as d3 from preds),
x as (select *, case when y_pred in (1,2) then case when d1=1 then 2 else 1 end else y_pred end as s1 from c),
y as (select *, case when s1 in (3,4) then case when d2 then 4 else 3 end else s1 end as s2 from x)
select row_id, model, case when s2 in (2,4) then case when d3 then 4 else 2 end else s2 end::int as grade from y""")
def pair_corrections(fx):
    k = F.col("row_id")
    corrected = D.pair_corrections(F.col("y_pred"), [
        (1, 2, (k % 2).cast("int")), (3, 4, (k % 3 == 1).cast("int")), (2, 4, (k % 5 == 1).cast("int"))])
    return fx.preds.select("row_id", "model", corrected.alias("grade"))


@query("m12_soft_voting", "predictions", """
with p as (select row_id, max(case when model='m1' then prob end) as a, max(case when model='m2' then prob end) as b from predictions group by row_id),
v as (select row_id, list_transform([1,2,3,4,5], lambda i: (a[i]+b[i])/2) as even, list_transform([1,2,3,4,5], lambda i: (a[i]*2+b[i])/3) as wgt from p)
select row_id, """ + ", ".join(f"round(even[{k + 1}],6) as even_{k}, round(wgt[{k + 1}],6) as weighted_{k}" for k in range(5)) + " from v")
def soft_voting(fx):
    from gradewell.models.ensemble import vote
    even = vote(fx.predictions, ["m1", "m2"]).select("row_id", F.col("prob").alias("even"))
    weighted = vote(fx.predictions, ["m1", "m2"], [2.0, 1.0]).select("row_id", F.col("prob").alias("weighted"))
    both = even.join(weighted, "row_id")
    return tidy(both.select("row_id", *[F.col(c)[k].alias(f"{c}_{k}") for c in ("even", "weighted") for k in K.GRADES]))
