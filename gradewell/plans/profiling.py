"""Queries that profile and audit the feature table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.functions.features import group_of
from gradewell.operators import profile as P
from gradewell.operators import ranking as R
from gradewell.plans.fixtures import FEATURES
from gradewell.plans.registry import CATALOG
from gradewell.plans.tools import tidy

query = CATALOG.query


def seven(c: Column, digits: int = 7) -> Column:
    """Round to ``digits`` places after the first digit, for values of any magnitude."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))).cast("double"))
    return F.when(c == 0, 0.0).otherwise(F.round(c / scale, digits) * scale)


def seven_sql(c: str, digits: int = 7) -> str:
    return (f"case when ({c})=0 then 0 else round(({c})/pow(10.0::double,floor(log10(abs({c})))),{digits})"
            f"*pow(10.0::double,floor(log10(abs({c})))) end")


def long_sql(columns=FEATURES, source: str = "feats") -> str:
    return "long as (" + " union all ".join(
        f"select row_id, label, source, '{f}' as feature, {f}::double as v from {source}" for f in columns) + ")"


FILLED = ("filled as (select row_id, label, source, feature, coalesce(v, med) as v from long join "
          "(select feature, coalesce(quantile_cont(v,0.5),0) as med from long group by feature) using (feature))")


def dirty(fx):
    """The feature table with NaN and infinite cells, as a raw file would bring them."""
    key = F.col("row_id")
    return fx.feats.withColumns({
        "qty_sum": F.when(key % 17 == 0, float("nan")).otherwise(F.col("qty_sum")),
        "total": F.when(key % 19 == 0, float("inf")).when(key % 23 == 0, float("-inf")).otherwise(F.col("total")),
    })


DIRTY = """dirty as (select * exclude (qty_sum, total), case when row_id%17=0 then 'nan'::double else qty_sum end as qty_sum,
  case when row_id%19=0 then 'inf'::double when row_id%23=0 then '-inf'::double else total end as total from feats)"""


@query("e01_class_distribution", "feats", """
with c as (select k as label, count(row_id) as n from (select unnest([0,1,2,3,4,5])::int as k) left join feats on label=k group by k)
select label, n, round(n/sum(n) over (),6) as share, round(max(n) over ()::double/min(case when n>0 then n end) over (),6) as max_to_min,
  max(n) over ()::double/min(case when n>0 then n end) over () >= 1.5 as is_imbalanced from c""")
def class_distribution(fx):
    return tidy(P.class_distribution(fx.feats, "label", [*K.GRADES, 5]))


@query("e02_class_by_source", "feats", "select source, "
       + ", ".join(f"sum((label={k})::int)::bigint as n_{k}" for k in range(5)) + ", count(*) as total from feats group by source")
def class_by_source(fx):
    return P.class_table(fx.feats, "source", "label")


@query("e02_class_source_cube", "feats",
       "select source, label, count(*) as n, grouping_id(source, label)::bigint as level from feats group by cube (source, label)")
def class_source_cube(fx):
    return P.class_cube(fx.feats, "source", "label")


@query("e03_class_by_split", "feats", "select case when row_id%10<6 then 'train' when row_id%10<8 then 'val' else 'test' end as split, "
       + ", ".join(f"sum((label={k})::int)::bigint as n_{k}" for k in range(5)) + ", count(*) as total from feats group by 1")
def class_by_split(fx):
    key = F.col("row_id") % 10
    split = F.when(key < 6, "train").when(key < 8, "val").otherwise("test")
    return P.class_table(fx.feats.select("label", split.alias("split")), "split", "label")


@query("e04_column_quality", "feats", f"""with {DIRTY}, {long_sql(source='dirty')},
c as (select *, case when isnan(v) or isinf(v) then null else v end as f from long)
select feature, count(*) as n_rows, count(f) as n, sum((v is null)::int)::bigint as n_null, sum(coalesce(isnan(v),false)::int)::bigint as n_nan,
  sum(coalesce(isinf(v),false)::int)::bigint as n_inf, min(f) as minimum, max(f) as maximum, {seven_sql('var_pop(f)')} as var_pop from c group by feature""")
def column_quality(fx):
    profile = P.column_profile(dirty(fx), FEATURES)
    return profile.select("feature", "n_rows", "n", "n_null", "n_nan", "n_inf", "minimum", "maximum", seven(F.col("var_pop")).alias("var_pop"))


@query("e04_quality_totals", "feats", f"""with {DIRTY}, {long_sql(source='dirty')},
c as (select *, case when isnan(v) or isinf(v) then null else v end as f from long),
p as (select feature, coalesce(case when min(f)=max(f) then 0 else var_pop(f) end, 0) as variance, count(*) as n_rows,
  sum((v is null or isnan(v))::int)::bigint as nans, sum(coalesce(isinf(v),false)::int)::bigint as infs from c group by feature)
select max(n_rows) as row_count, count(*) as feature_count, sum(nans)::bigint as nan_cells, sum(infs)::bigint as inf_cells,
  {seven_sql('min(variance)')} as variance_min, {seven_sql('quantile_cont(variance,0.5)')} as variance_median, {seven_sql('max(variance)')} as variance_max from p""")
def quality_totals(fx):
    totals = P.quality_totals(dirty(fx), FEATURES)
    return totals.withColumns({c: seven(F.col(c)) for c in ("variance_min", "variance_median", "variance_max")})


@query("e05_variance_audit", "feats", f"""with {long_sql()},
vc as (select feature, v, count(*) as m from long where v is not null group by all),
s as (select feature, count(*) as d, max(m)::double/sum(m) as top, count(*)::double/sum(m) as ratio from vc group by feature),
p as (select feature, var_pop(v) as vp from long group by feature)
select feature, {seven_sql('case when coalesce(d,0)<=1 then 0 else vp end')} as variance, coalesce(d,0)<=1 as is_constant,
  coalesce(d,0)>1 and (vp<=1e-8 or (ratio<0.01 and top>0.95)) as near_zero_variance from p left join s using (feature)""")
def variance_audit(fx):
    return P.variance_audit(fx.feats_once, FEATURES).withColumn("variance", seven(F.col("variance")))


AUDIT = f"""{long_sql()}, {FILLED},
vc as (select feature, v, count(*) as m from filled group by all),
s as (select feature, count(*) as d, max(m)::double/sum(m) as top from vc group by feature),
audit as (select feature, var_samp(v) as variance, any_value(d)<=1 as is_constant,
  any_value(d)>1 and (var_samp(v)<=1e-8 or any_value(top)>=0.995) as near_constant from filled join s using (feature) group by feature)"""


@query("e06_filled_audit", "feats", f"with {AUDIT} select feature, {seven_sql('variance')} as variance, is_constant, near_constant from audit")
def filled_audit(fx):
    return P.filled_audit(fx.feats_once, FEATURES).withColumn("variance", seven(F.col("variance")))


VERSIONS = {"all": [*FEATURES, "qty_same", "qty_again"], "quantities": ["qty_sum", "qty_max", "qty_dup", "n_lines"],
            "prices": ["price_max", "total", "disc_max"], "copies": ["qty_same", "qty_again", "tax_max"]}


def version_sql(name, columns) -> str:
    cells = "+".join(f"({c} is null)::int" for c in columns)
    constant = "+".join(f"(count(distinct {c})+max(({c} is null)::int)<=1)::int" for c in columns)
    flat = "+".join(f"coalesce(stddev_samp({c})<1e-8,false)::int" for c in columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    # A column is a copy if any earlier one of the version is equal to it.
    copies = "+".join("(" + " or ".join(f"sum(({a} is distinct from {b})::int)=0" for a in columns[:i]) + ")::int" for i, b in enumerate(columns) if i)
    high = "+".join(f"coalesce(abs(case when stddev_samp({a})>0 and stddev_samp({b})>0 then corr({a},{b}) end)>0.995,false)::int" for a, b in pairs)
    return (f"select '{name}' as feature_version, {len(columns)}::bigint as feature_count, sum({cells})::bigint as missing_cells, ({constant})::bigint as constant_features, "
            f"({flat})::bigint as near_constant_features, ({copies})::bigint as duplicate_features, ({high})::bigint as correlated_pairs from copied")


@query("e07_version_audit", "copied", " union all ".join(version_sql(n, c) for n, c in VERSIONS.items()))
def version_audit(fx):
    copied = fx.feats_once.withColumns({"qty_same": F.col("qty_sum"), "qty_again": F.col("qty_sum")})
    return P.version_audit(copied, VERSIONS, "row_id")


@query("e08_extreme_features", "feats", f"""with {long_sql()}
select feature, max(abs(v))>1e5 as is_extreme, var_samp(v)=0 as zero_variance, sum((v is null)::int)::bigint as missing_cells from long group by feature""")
def extreme_features(fx):
    return P.extreme_features(fx.feats, FEATURES, 1e5)


VARYING = ["n_lines", "qty_sum", "qty_max", "qty_dup", "price_max", "tax_max", "total", "disc_max"]
SPEARMAN = """rk as (select row_id, feature, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v)-1)/2.0::double as r from filled),
pairs as (select a.feature as feature_a, b.feature as feature_b, abs(corr(a.r,b.r)) as correlation from rk a join rk b on a.row_id=b.row_id
  join ord x on x.feature=a.feature join ord y on y.feature=b.feature where x.i<y.i group by all)"""
ORDER = "ord as (select * from (values " + ", ".join(f"('{f}',{i})" for i, f in enumerate(FEATURES)) + ") as t(feature, i))"


@query("e09_spearman_pairs", "feats", f"with {long_sql(VARYING)}, {FILLED}, {ORDER}, {SPEARMAN} "
       "select feature_a, feature_b, round(correlation,6) as correlation from pairs where correlation>=0.5")
def spearman_pairs(fx):
    filled = P.fill_medians(fx.feats_once, VARYING, P.medians(fx.feats_once, VARYING))
    return tidy(P.correlation_pairs(filled, VARYING).filter("correlation >= 0.5"))


@query("e09_pearson_pairs", "feats", "select * from (" + " union all ".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, round(abs(corr({a},{b})),6) as correlation from feats"
    for i, a in enumerate(VARYING) for b in VARYING[i + 1:]) + ")")
def pearson_pairs(fx):
    return tidy(P.pairwise_pearson(fx.feats_once, VARYING))


PRIORITY_SQL = """case when lower({0}) like '%quality\\_%' escape '\\' or lower({0}) like '%brightness%' or lower({0}) like '%blur%' or lower({0}) like '%sharpness%'
  or lower({0}) like '%contrast%' or lower({0}) like '%snr%' then 0 when lower({0}) like '%color%' then 1
  when lower({0}) like '%texture%' or lower({0}) like '%glcm%' or lower({0}) like '%lbp%' then 2 else 3 end"""
DROPS = f"""va as (select feature, var_samp(v) as variance from filled group by feature),
drops as (select feature_a, feature_b, correlation, case when {PRIORITY_SQL.format('feature_a')} < {PRIORITY_SQL.format('feature_b')} then feature_a
    when {PRIORITY_SQL.format('feature_a')} > {PRIORITY_SQL.format('feature_b')} then feature_b
    when x.variance < y.variance then feature_a else feature_b end as suggested_remove
  from pairs join va x on x.feature=feature_a join va y on y.feature=feature_b where correlation>=0.9)"""


def correlated(fx, columns):
    filled = P.fill_medians(fx.feats_once, columns, P.medians(fx.feats_once, columns))
    variances = P.column_profile(filled, columns).select("feature", F.col("var_samp").alias("variance"))
    return P.correlated_drops(P.correlation_pairs(filled, columns), variances, 0.9)


@query("e10_correlated_drops", "feats", f"with {long_sql(VARYING)}, {FILLED}, {ORDER}, {SPEARMAN}, {DROPS} "
       "select feature_a, feature_b, round(correlation,6) as correlation, suggested_remove from drops")
def correlated_drops(fx):
    return tidy(correlated(fx, VARYING))


@query("e11_removed_features", "feats", f"""with {AUDIT}, {ORDER}, {SPEARMAN.replace('from filled)', "from filled where feature not in ('const_one','near_const'))")}, {DROPS}
select feature, 'constant' as reason from audit where is_constant
union all select feature, 'near_constant' from audit where near_constant and feature not like '%ma%'
union all select distinct suggested_remove, 'highly_correlated_duplicate' from drops
  where suggested_remove not in (select feature from audit where is_constant or near_constant)""")
def removed_features(fx):
    audit = P.filled_audit(fx.feats_once, FEATURES)
    return P.removed_features(audit, correlated(fx, VARYING), P.is_finding(F.col("feature")))


@query("e12_acquisition_risk", "feats", f"""with {long_sql()}
select feature, {seven_sql('avg(case when label=0 then v end)')} as neg_mean, {seven_sql('avg(case when label>=2 then v end)')} as pos_mean,
  round(abs(avg(case when label=0 then v end)-avg(case when label>=2 then v end))/(case when stddev_samp(v)=0 then 1 else stddev_samp(v) end),6) as standardized_gap
from long group by feature""")
def acquisition_risk(fx):
    gaps = P.acquisition_risk(fx.feats, FEATURES, hinted_only=False)
    return gaps.select("feature", seven(F.col("neg_mean")).alias("neg_mean"), seven(F.col("pos_mean")).alias("pos_mean"),
                       F.round("standardized_gap", 6).alias("standardized_gap"))


MOMENTS = f"""{long_sql()},
g as (select feature, avg(v) as grand, count(v) as n from long group by feature),
c as (select feature, label, count(v) as nc, avg(v) as mc, var_pop(v) as vc from long group by all),
mo as (select feature, sum(nc*pow(mc-grand,2)) as b, sum(nc*vc) as w, any_value(n) as n, sum((nc>0)::int) as k from c join g using (feature) group by feature)"""


@query("e13_fisher_scores", "feats", f"with {MOMENTS} select feature, round(b/greatest(w,1e-9::double),9) as score from mo")
def fisher_scores(fx):
    return tidy(P.fisher_scores(fx.feats_once, FEATURES), 9)


@query("e14_anova_f", "feats", f"with {MOMENTS} select feature, case when w>0 then round((b/(k-1))/(w/(n-k)),6) end as score from mo")
def anova_f(fx):
    return tidy(P.anova_f(fx.feats_once, FEATURES))


MUTUAL = f"""{long_sql()},
q as (select feature, quantile_cont(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) as e from long group by feature),
b as (select feature, label, len(list_filter(e, lambda x: v > x)) as bin from long join q using (feature) where v is not null),
t as (select feature, bin, label, count(*) as m from b group by all),
w as (select *, sum(m) over (partition by feature)::double as n, sum(m) over (partition by feature, bin)::double as nb, sum(m) over (partition by feature, label)::double as nl from t)"""


@query("e15_binned_mutual_information", "feats", f"with {MUTUAL} select feature, round(sum(m/n*ln(m*n/(nb*nl))),9) as score from w group by feature")
def binned_mutual_information(fx):
    return tidy(P.binned_mutual_information(fx.feats_once, FEATURES), 9)


@query("e16_feature_group_counts", "feats", f"""with {MOMENTS}, r as (select feature, row_number() over (order by b/greatest(w,1e-9::double) desc, feature) as rank from mo),
s as (select unnest([3,6,10]) as size),
t as (select 'top_' || size as feature_set, case when feature like 'qty%' then 'quantity' when feature like 'price%' or feature='total' then 'money' else 'unknown' end as g
  from r cross join s where rank<=size union all select 'all', case when feature like 'qty%' then 'quantity' when feature like 'price%' or feature='total' then 'money' else 'unknown' end from r)
select feature_set, sum(n)::bigint as feature_count, string_agg(g || ':' || n, ',' order by g || ':' || n) as feature_groups
from (select feature_set, g, count(*) as n from t group by all) group by feature_set""")
def feature_group_counts(fx):
    ranked = R.rank_features(P.fisher_scores(fx.feats_once, FEATURES))
    sets = R.top_subsets(ranked, [3, 6, 10])
    name = F.col("feature")
    group = F.when(name.startswith("qty"), "quantity").when(name.startswith("price") | (name == "total"), "money")
    dictionary = ranked.select("feature", group.alias("feature_group")).filter("feature_group is not null")
    return P.group_counts(sets, dictionary)


@query("e17_medians", "feats", f"with {long_sql()} select feature, {seven_sql('coalesce(quantile_cont(v,0.5),0)')} as median from long group by feature")
def medians(fx):
    return P.medians(fx.feats_once, FEATURES).withColumn("median", seven(F.col("median")))


@query("e18_distribution_shape", "feats", f"""with {long_sql()},
m as (select feature, min(v) as lo, max(v) as hi, avg(v) as mu, stddev_pop(v) as sd from long group by feature),
m2 as (select feature, case when lo=hi then lo-0.5 else lo end as lo, case when lo=hi then hi+0.5 else hi end as hi, mu, sd from m),
b as (select feature, least(floor((v-lo)/(hi-lo)*16),15) as bin, v, mu, sd from long join m2 using (feature) where v is not null),
h as (select feature, sum(-p*log2(p)) as entropy from (select feature, count(*)::double/sum(count(*)) over (partition by feature) as p from b group by feature, bin) group by feature),
s as (select feature, case when any_value(sd)<=1e-8 then 0 else avg(pow((v-mu)/sd,3)) end as skewness,
  case when any_value(sd)<=1e-8 then 0 else avg(pow((v-mu)/sd,4))-3 end as kurtosis from b group by feature)
select feature, round(entropy,6) as entropy, round(entropy/4,6) as normalized_entropy, round(skewness,6) as skewness, round(kurtosis,5) as kurtosis from h join s using (feature)""")
def distribution_shape(fx):
    shape = P.distribution_shape(fx.feats_once, FEATURES)
    return shape.select("feature", *[F.round(c, 5 if c == "kurtosis" else 6).alias(c) for c in shape.columns[1:]])


SIDES = [("superior", "y<24.5"), ("inferior", "y>=24.5"), ("nasal", "x>=25"), ("temporal", "x<25")]
QUADS = [("x<25 and y<24.5"), ("x>=25 and y<24.5"), ("x<25 and y>=24.5"), ("x>=25 and y>=24.5")]


@query("e19_region_statistics", "regions", "with r as (select image_id, kind, count(*) as n, round(sum(area),2) as area, round(avg(area),7) as mean_area, "
       "max(area) as max_area, round(avg(sqrt(pow(x-30,2)+pow(y-21,2))),6) as distance_mean, round(min(sqrt(pow(x-30,2)+pow(y-21,2))),6) as distance_min, "
       + ", ".join(f"sum(({c})::int)::bigint as n_{s}" for s, c in SIDES) + ", round(sum(area)/2450.0::double,6) as density, ("
       + "+".join(f"(sum(case when {c} then area else 0 end)>=30000)::int" for c in QUADS) + ")::int as occupied_quadrants from regions group by image_id, kind) "
       "select *, round((" + "+".join(
           f"case when n_{s}>0 then -(n_{s}::double/(2*n))*log2(n_{s}::double/(2*n)) else 0 end" for s, _ in SIDES) + ")/2,6) as sector_entropy from r")
def region_statistics(fx):
    stats = P.region_statistics(fx.regions, "image_id", "kind", (30.0, 21.0), (25.0, 24.5), 2450.0, 30000.0)
    digits = {"area": 2, "mean_area": 7, "distance_mean": 6, "distance_min": 6, "density": 6, "sector_entropy": 6}
    return stats.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("e20_grid_occupancy", "regions", "select image_id, " + ", ".join(
    f"sum((least(floor(y*4/49),3)={r} and least(floor(x*4/50),3)={c})::int)::bigint as cell_{r}_{c}" for r in range(4) for c in range(4))
    + " from regions group by image_id")
def grid_occupancy(fx):
    grid = P.grid_occupancy(fx.regions, "image_id", 50.0, 49.0)
    return grid.select("image_id", *[F.col("grid")[4 * r + c].alias(f"cell_{r}_{c}") for r in range(4) for c in range(4)])


@query("d09_duplicate_columns", "feats", "select * from (" + " union all ".join(
    f"select '{b}' as feature, '{a}' as duplicate_of from feats having sum(({a} is distinct from {b})::int)=0"
    for a, b in [("qty_dup", "qty_copy"), ("qty_sum", "qty_dup")]).replace("from feats", "from (select *, qty_dup as qty_copy from feats)") + ")")
def duplicate_columns(fx):
    copied = fx.feats.withColumn("qty_copy", F.col("qty_dup"))
    return P.duplicate_columns(copied, [*FEATURES, "qty_copy"], "row_id")
