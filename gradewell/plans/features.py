"""Queries that coerce, clean and derive feature columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.functions import features as X
from gradewell.functions import numeric as N
from gradewell.operators import ingest as I
from gradewell.plans.fixtures import FEATURES, MEASURES
from gradewell.plans.profiling import DIRTY, dirty, seven, seven_sql
from gradewell.plans.registry import CATALOG
from gradewell.plans.tools import tidy

query = CATALOG.query


@query("b01_numeric_coercion", "", """
select event_id, try_cast(regexp_extract(props,'[0-9]+',0) as double) as number, try_cast(event_type as double) as text_number,
  try_cast(case event_id % 4 when 0 then ' 12.5 ' when 1 then '1e3' when 2 then 'n/a' else '' end as double) as mixed from events""")
def numeric_coercion(fx):
    mixed = F.expr("case event_id % 4 when 0 then ' 12.5 ' when 1 then '1e3' when 2 then 'n/a' else '' end")
    return fx.table("events").select(
        "event_id", N.to_double(F.regexp_extract("props", "[0-9]+", 0)).alias("number"),
        N.to_double(F.col("event_type")).alias("text_number"), N.to_double(mixed).alias("mixed"))


CLEAN = "case when isnan({0}) or isinf({0}) then null else {0} end"


@query("b02_sanitized_rows", "feats", f"""with {DIRTY}, c as (select row_id, {CLEAN.format('qty_sum')} as qty_sum, {CLEAN.format('total')} as total,
  disc_max from dirty) select * from c where qty_sum is not null or total is not null or disc_max is not null""")
def sanitized_rows(fx):
    clean = I.sanitize(dirty(fx), ["qty_sum", "total", "disc_max"])
    return clean.select("row_id", "qty_sum", "total", "disc_max")


@query("b02_sanitize_report", "feats", f"""with {DIRTY}, l as (select row_id, unnest([qty_sum, total, disc_max]) as v from dirty),
r as (select row_id, sum((v is not null and not isnan(v) and not isinf(v))::int) as ok from l group by row_id)
select sum((v is null or isnan(v))::int)::bigint as nan_cells_before, sum(coalesce(isinf(v),false)::int)::bigint as inf_cells_before,
  (select count(*) from r where ok=0) as rows_removed,
  (sum((v is null or isnan(v) or isinf(v))::int) - 3*(select count(*) from r where ok=0))::bigint as missing_cells_after,
  max(case when not isinf(v) and not isnan(v) then abs(v) end) as max_abs_after from l""")
def sanitize_report(fx):
    return I.sanitize_report(dirty(fx), ["qty_sum", "total", "disc_max"])


@query("b07_safe_ratios", "feats", """
select row_id, round(qty_sum/greatest(n_lines,1),6) as floor_one,
  round(case when disc_max is null then 0 else qty_max/greatest(abs(disc_max),1) end,6) as abs_floor_one,
  round(total/(abs(qty_sum)+1e-6::double),6) as with_epsilon, round(2*tax_max*near_const/greatest(tax_max+near_const,1e-6::double),6) as harmonic from feats""")
def safe_ratios(fx):
    c = F.col
    return tidy(fx.feats.select(
        "row_id", N.ratio_floor_one(c("qty_sum"), c("n_lines")).alias("floor_one"),
        N.ratio_abs_floor_one(c("qty_max"), c("disc_max")).alias("abs_floor_one"),
        N.ratio_epsilon(c("total"), c("qty_sum")).alias("with_epsilon"),
        N.harmonic_guarded(c("tax_max"), c("near_const")).alias("harmonic")))


# NULL cells count as 0 in derived features.
ZEROED = "z as (select row_id, label, ma_count, ma_area, hemorrhage_area, " + ", ".join(f"coalesce({m},0) as {m}" for m in MEASURES) + " from measures)"


def rounded(columns: dict[str, str]) -> str:
    return ", ".join(f"{seven_sql(expression, 11)} as {name}" for name, expression in columns.items())


def derived(df, columns):
    features = df.select("row_id", *[c.alias(name) for name, c in columns.items()])
    return features.select("row_id", *[seven(F.col(name), 11).alias(name) for name in columns])


BURDEN = {
    "lesion_burden": "ln(1+total_lesion_area)+ln(1+total_lesion_count)",
    "exudate_burden": "ln(1+ea)+ed",
    "hemorrhage_burden": "ln(1+hemorrhage_area)+hemorrhage_density",
    "vessel_abnormality": "vc+hemorrhage_area/greatest(abs(vl),1)",
    "ma_density_score": "ma_density+ma_density_per_retinal_area+ma_count/greatest(abs(total_lesion_count),1)",
    "exudate_to_ma": "ea/greatest(abs(ma_area),1)+ec/greatest(abs(ma_count),1)",
    "hemorrhage_to_vessel": "hemorrhage_area/greatest(abs(vl),1)+hemorrhage_count/greatest(abs(vessel_density+vessel_area_ratio),1)",
    "total_lesion_count": "total_lesion_count",
    "total_lesion_area": "total_lesion_area",
    "referable_pathology": "(ln(1+total_lesion_area)+ln(1+total_lesion_count))+1.4::double*(ln(1+hemorrhage_area)+hemorrhage_density)+1.2::double*(ln(1+ea)+ed)",
}


@query("b08_burden_features", "measures", f"""with {ZEROED}, a as (select *, exudate_count+hard_exudate_count+soft_exudate_count as ec,
  exudate_area+hard_exudate_area+soft_exudate_area as ea, exudate_density+hard_exudate_coverage_pct as ed, vessel_length+vessel_skeleton_length as vl,
  vessel_complexity_score+vessel_fragmentation_index+vessel_tortuosity_mean+vessel_tortuosity_std as vc from z),
b as (select *, ma_count+ec+hemorrhage_count+cotton_wool_count as total_lesion_count, ma_area+ea+hemorrhage_area+cotton_wool_area as total_lesion_area from a)
select row_id, {rounded(BURDEN)} from b""")
def burden_features(fx):
    return derived(fx.measures, X.burden_features(fx.measures))


SEVERITY = {
    "total_lesion_count": "ma_count+exudate_count+hemorrhage_count+cotton_wool_count",
    "combined_lesion_burden": "combined_lesion_area",
    "lesion_density_score": "combined_lesion_area/greatest(fov_area,1)",
    "hemorrhage_to_ma_ratio": "hemorrhage_count/greatest(ma_count,1)",
    "vessel_abnormality_score": "vessel_tortuosity_mean+vessel_fragmentation_index*100+vessel_curvature_mean",
    "exudate_burden_score": "exudate_density+soft_exudate_coverage_pct/100",
    "advanced_dr_indicator_score": "hemorrhage_count*0.5::double+cotton_wool_count*0.7::double+(exudate_density+soft_exudate_coverage_pct/100)*100"
                                   "+(vessel_tortuosity_mean+vessel_fragmentation_index*100+vessel_curvature_mean)",
    "neovascularization_likelihood_score": "vessel_branchpoint_count*vessel_tortuosity_mean/greatest(fov_area/10000,1)",
}
SCORED = f"{ZEROED}, s as (select *, " + ", ".join(f"{e} as {n}" for n, e in SEVERITY.items()) + " from z)"


@query("b09_severity_features", "measures", f"with {ZEROED} select row_id, {rounded(SEVERITY)} from z")
def severity_features(fx):
    return derived(fx.measures, X.severity_features(fx.measures))


def scored(fx):
    return fx.measures.select("*", *[c.alias(n) for n, c in X.severity_features(fx.measures).items()])


INTERACTIONS = {
    "ma_to_exudate_ratio": "ma_count/greatest(exudate_count,1)",
    "hemorrhage_to_exudate_ratio": "hemorrhage_count/greatest(exudate_count,1)",
    "lesion_vessel_interaction": "lesion_density_score*vessel_density",
    "texture_lesion_interaction": "lesion_density_score*glcm_contrast",
    "quality_adjusted_lesion_density": "lesion_density_score*(greatest(quality_contrast,1)/50)",
    "area_adjusted_ma_count": "ma_count/greatest(fov_area/10000,1)",
    "area_adjusted_exudate_count": "exudate_count/greatest(fov_area/10000,1)",
    "area_adjusted_hemorrhage_count": "hemorrhage_count/greatest(fov_area/10000,1)",
    "referable_lesion_score": "exudate_burden_score+hemorrhage_to_ma_ratio+lesion_density_score",
    "stage_progression_score": "advanced_dr_indicator_score+vessel_abnormality_score",
}


@query("b09_interaction_features", "measures", f"with {SCORED} select row_id, {rounded(INTERACTIONS)} from s")
def interaction_features(fx):
    table = scored(fx)
    return derived(table, X.interaction_features(table))


def mean4(stem):
    return f"({stem}_0+{stem}_45+{stem}_90+{stem}_135)/4"


def range4(*names):
    return f"greatest({','.join(names)})-least({','.join(names)})"


def per(a, b):
    return f"({a})/(abs({b})+1e-6::double)"


BRIGHT_AREA = "(hard_exudate_area+soft_exudate_area+cotton_wool_area)"
BRIGHT_COUNT = "(hard_exudate_count+soft_exudate_count+cotton_wool_count)"
SIDES4 = ["ma_superior_count", "ma_inferior_count", "ma_nasal_count", "ma_temporal_count"]
SPREAD4 = "(" + "+".join(f"({s}>0)::int::double" for s in SIDES4) + ")"
BLEED = "ln(1+hemorrhage_area)*ln(1+hemorrhage_count+1)"
STUDY = {
    "study_glcm_contrast_mean_directional": mean4("glcm_contrast"),
    "study_glcm_contrast_range_directional": range4(*[f"glcm_contrast_{d}" for d in (0, 45, 90, 135)]),
    "study_glcm_energy_mean_directional": mean4("glcm_energy"),
    "study_glcm_energy_range_directional": range4(*[f"glcm_energy_{d}" for d in (0, 45, 90, 135)]),
    "study_glcm_asm_proxy": "glcm_energy*glcm_energy",
    "study_glcm_homogeneity_contrast_ratio": per("glcm_homogeneity", "glcm_contrast"),
    "study_glcm_entropy_correlation_interaction": "glcm_entropy*glcm_correlation",
    "study_lbp_entropy_uniform_ratio": per("lbp_entropy", "lbp_uniform_ratio+1"),
    "study_lbp_variation_index": per("lbp_std", "abs(lbp_mean)+1"),
    "study_lbp_texture_stability": per("lbp_uniform_ratio", "lbp_entropy+1"),
    "study_texture_contrast_lbp_interaction": "glcm_contrast*lbp_entropy",
    "study_bright_lesion_total_area_log": f"ln(1+{BRIGHT_AREA})",
    "study_bright_lesion_total_count_log": f"ln(1+{BRIGHT_COUNT})",
    "study_bright_lesion_mean_area": per(BRIGHT_AREA, f"{BRIGHT_COUNT}+1"),
    "study_exudate_macula_risk": per(BRIGHT_AREA, "hard_exudate_distance_to_macula_mean+soft_exudate_distance_to_macula_mean+1"),
    "study_exudate_optic_disc_fp_risk": per(BRIGHT_AREA, "hard_exudate_distance_to_optic_disc_mean+soft_exudate_distance_to_optic_disc_mean+1"),
    "study_hard_soft_exudate_balance": per("hard_exudate_area", "soft_exudate_area+1"),
    "study_red_lesion_total_area_log": "ln(1+ma_area+hemorrhage_area)",
    "study_red_lesion_total_count_log": "ln(1+ma_count+hemorrhage_count)",
    "study_red_lesion_density_combined": "ma_density+hemorrhage_density",
    "study_ma_presence_strength": "ln(1+ma_count)*ln(1+ma_area)",
    "study_ma_quadrant_spread": SPREAD4,
    "study_ma_quadrant_asymmetry": range4(*SIDES4),
    "study_hemorrhage_severity_index": BLEED,
    "study_hemorrhage_retina_extent_index": "hemorrhage_area*hemorrhage_retina_affected_pct",
    "study_hemorrhage_ma_ratio_log": "ln(1+" + per("hemorrhage_area+1", "ma_area+1") + ")",
    "study_vessel_branching_density": per("vessel_branching_count", "vessel_length+1"),
    "study_vessel_width_tortuosity_index": "vessel_average_width*(vessel_tortuosity_mean+vessel_curvature_mean)",
    "study_vessel_complexity_density_ratio": per("vessel_complexity_score", "vessel_density+0.001::double"),
    "study_vessel_fragmentation_density": "vessel_fragmentation_index*vessel_density",
    "study_quality_low_contrast_flag": "(quality_contrast<c10)::int::double",
    "study_quality_dark_flag": "(quality_brightness<b10)::int::double",
    "study_quality_bright_flag": "(quality_brightness>b90)::int::double",
    "study_quality_blur_flag": "(quality_blur_score<u10)::int::double",
    "study_quality_adjusted_red_lesion": per("ma_area+hemorrhage_area", "quality_blur_score+quality_contrast+1"),
    "study_quality_adjusted_bright_lesion": per(BRIGHT_AREA, "quality_blur_score+quality_contrast+1"),
    "study_referable_safety_score": "referable_lesion_score+stage_progression_score+advanced_dr_indicator_score",
    "study_severe_npdr_score": f"{BLEED}+vessel_abnormality_score+{SPREAD4}",
    "study_pdr_support_score": "neovascularization_likelihood_score+vessel_abnormality_score+advanced_dr_indicator_score",
}


@query("b10_study_features", "measures", f"""with {SCORED}, i as (select *, {', '.join(f'{e} as {n}' for n, e in INTERACTIONS.items())} from s),
q as (select quantile_cont(quality_contrast,0.1) as c10, quantile_cont(quality_brightness,0.1) as b10, quantile_cont(quality_brightness,0.9) as b90,
  quantile_cont(quality_blur_score,0.1) as u10 from i)
select row_id, {rounded(STUDY)} from i cross join q""")
def study_features(fx):
    table = scored(fx)
    table = table.select("*", *[c.alias(n) for n, c in X.interaction_features(table).items()])
    return derived(table, X.study_features(table, X.quality_cuts(table)))


GROUP_SQL = """case when feature like 'vessel\\_%' escape '\\' then 'vessel' when feature like 'hemorrhage%' then 'lesion_hemorrhage'
  when feature like 'ma\\_%' escape '\\' then 'lesion_microaneurysm' when feature like '%exudate%' or feature like '%cotton\\_wool%' escape '\\' or feature like '%bright\\_lesion%' escape '\\' then 'lesion_exudate'
  when feature like '%glcm%' then 'texture_glcm' when feature like '%lbp%' or feature like '%texture%' or feature like '%wavelet%' or feature like '%fft%' then 'texture_lbp'
  when feature like 'quality\\_%' escape '\\' then 'quality' when feature like '%optic\\_disc%' escape '\\' then 'optic_disc' else 'existing' end"""


def name_table(fx, names):
    """Feature names of a table with the share of present cells, one row per name."""
    from gradewell.operators.profile import column_profile
    return column_profile(fx.measures, names).select("feature", (F.col("n") / F.col("n_rows")).alias("present"))


GROUPED = ["exudate_count", "ma_density", "hemorrhage_count", "vessel_length", "glcm_energy_45", "lbp_mean",
           "quality_contrast", "hard_exudate_distance_to_optic_disc_mean", "fov_area", "cotton_wool_area"]


@query("b11_feature_groups", "measures", f"""with l as ({' union all '.join(
    f"select '{n}' as feature, avg(({n} is not null)::int) as present from measures" for n in GROUPED)})
select feature, round(present,6) as present, {GROUP_SQL} as feature_group from l""")
def feature_groups(fx):
    return tidy(name_table(fx, GROUPED).withColumn("feature_group", X.group_of(F.col("feature"))))


PREFIXES = ["handcrafted__", "selected75__", "selected100__", "cnn_embedding__", "cnn__"]


@query("b11_prefixed_groups", "", """
with n as (select p_partkey, ['handcrafted__','selected75__','selected100__','cnn_embedding__','cnn__'][1 + p_partkey % 5] || p_brand as feature from part)
select p_partkey, feature, case p_partkey % 5 when 0 then 'handcrafted' when 1 then 'selected_75' when 2 then 'selected_100' when 3 then 'embedding' else 'image_prediction' end as feature_group from n""")
def prefixed_groups(fx):
    prefix = F.array(*[F.lit(p) for p in PREFIXES])[(F.col("p_partkey") % 5).cast("int")]
    names = fx.table("part").select("p_partkey", F.concat(prefix, "p_brand").alias("feature"))
    return names.withColumn("feature_group", X.hybrid_group_of(F.col("feature")))


@query("b26_selected_features", "measures", """
select row_id, coalesce(vessel_density,0) as vessel_density, coalesce(ma_density, ma_count/100) as ma_density,
  round(total_area,6) as total_area from (select *, ma_area+hemorrhage_area as total_area from measures)""")
def selected_features(fx):
    fallbacks = {"ma_density": F.col("ma_count") / 100, "total_area": F.col("ma_area") + F.col("hemorrhage_area")}
    chosen = X.select_features(fx.measures, ["vessel_density", "ma_density", "total_area"], fallbacks)
    return tidy(fx.measures.select("row_id", *chosen))


@query("b28_trial_params", "", """
with t as (select event_id, event_type as model, case when event_id%9=0 then 'nan' else (100+event_id%50)::varchar || '.0' end as params_n_estimators,
  ((event_id%7)/10.0)::decimal(4,1)::varchar as params_learning_rate, props from events)
select event_id, model, case when params_n_estimators='nan' then null else cast(params_n_estimators as double)::bigint::varchar end as n_estimators,
  params_learning_rate as learning_rate from t""")
def trial_params(fx):
    """Trial rows with ``params_*`` columns gathered into one typed map, then read back."""
    trials = fx.table("events").select(
        "event_id", F.col("event_type").alias("model"),
        F.when(F.col("event_id") % 9 == 0, "nan").otherwise(F.concat((100 + F.col("event_id") % 50).cast("string"), F.lit(".0")))
        .alias("params_n_estimators"),
        ((F.col("event_id") % 7).cast("decimal(10,1)") / 10).cast("decimal(4,1)").cast("string").alias("params_learning_rate"))
    packed = I.pack_params(trials, ["params_n_estimators", "params_learning_rate"])
    return packed.select("event_id", "model", F.col("params")["n_estimators"].alias("n_estimators"),
                         F.col("params")["learning_rate"].alias("learning_rate"))


@query("b28_params_json", "", """
select event_id, json_keys(props)[i] as name, json_extract_string(props, '$.' || json_keys(props)[i]) as value, len(json_keys(props)) as n_keys
from (select event_id, props, unnest(range(1, len(json_keys(props)) + 1)) as i from events)""")
def params_json(fx):
    parsed = I.parse_params(fx.table("events"), "props")
    return parsed.select("event_id", F.explode("params").alias("name", "value"), F.size("params").cast("bigint").alias("n_keys"))


@query("b29_report_shares", "feats", """
select label, source, count(*) as n, round(count(*)*100.0::double/sum(count(*)) over (partition by label),2) as pct from feats group by label, source""")
def report_shares(fx):
    from pyspark.sql import Window
    counts = fx.feats.groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", I.percentage(F.col("n"), F.sum("n").over(Window.partitionBy("label"))))
