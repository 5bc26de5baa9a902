"""Queries that rank features and trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.operators import leaderboard as L
from gradewell.operators import profile as P
from gradewell.operators import ranking as R
from gradewell.plans.fixtures import FEATURES
from gradewell.plans.profiling import FILLED, MOMENTS, ORDER, SPEARMAN, VARYING, long_sql, seven, seven_sql
from gradewell.plans.registry import CATALOG
from gradewell.plans.tools import tidy

query = CATALOG.query
SCORES = f"""{MOMENTS}, sc as (select 'fisher' as method, feature, round(b/greatest(w,1e-9::double),9) as score from mo
  union all select 'anova', feature, case when w>0 then round((b/(k-1))/(w/(n-k)),6) end from mo),
cl as (select method, feature, coalesce(score,0) as score from sc)"""


def scores(fx):
    """Fisher and ANOVA scores from the same class moments, computed once."""
    from gradewell.session import settle
    moments = settle(P.class_moments(fx.feats_once, FEATURES))
    b, w, n, k = F.col("between"), F.col("within"), F.col("n"), F.col("classes")
    fisher = F.round(b / F.greatest(w, F.lit(1e-9)), 9)
    anova = F.round(F.when(w > 0, (b / (k - 1)) / (w / (n - k))), 6)
    return moments.select(F.lit("fisher").alias("method"), "feature", fisher.alias("score")).unionByName(
        moments.select(F.lit("anova").alias("method"), "feature", anova.alias("score")))


@query("f01_feature_ranks", "feats", f"with {SCORES} select method, feature, score, row_number() over (partition by method order by score desc, feature) as rank from cl")
def feature_ranks(fx):
    return R.rank_features(scores(fx), ["method"])


@query("f02_top_subsets", "feats", f"""with {SCORES}, r as (select *, row_number() over (partition by method order by score desc, feature) as rank from cl),
z as (select unnest([3,5,50]) as size)
select method, 'top_' || size as feature_set, string_agg(feature, ',' order by rank) as features from r cross join z where rank<=size group by all
union all select method, 'all', string_agg(feature, ',' order by rank) from r group by method""")
def top_subsets(fx):
    subsets = R.top_subsets(R.rank_features(scores(fx), ["method"]), [3, 5, 50], ["method"])
    return subsets.select("method", "feature_set", F.array_join("features", ",").alias("features"))


@query("f03_greedy_subset", "feats", f"""with recursive {MOMENTS}, {FILLED}, {ORDER}, {SPEARMAN},
r as (select feature, row_number() over (order by round(b/greatest(w,1e-9::double),9) desc, feature) as rank from mo where feature in ('{"','".join(VARYING)}')),
walk as (select 0::bigint as rank, []::varchar[] as chosen union all
  select walk.rank+1, case when exists (select 1 from pairs p where p.correlation>=0.9 and ((p.feature_a=r.feature and list_contains(walk.chosen, p.feature_b)) or (p.feature_b=r.feature and list_contains(walk.chosen, p.feature_a))))
    then walk.chosen else list_append(walk.chosen, r.feature) end from walk join r on r.rank=walk.rank+1)
select unnest(chosen) as feature, unnest(range(1, len(chosen)+1)) as position from (select chosen from walk order by rank desc limit 1)""")
def greedy_subset(fx):
    rows = fx.feats_once
    ranked = R.rank_features(P.fisher_scores(rows, VARYING).withColumn("score", F.round("score", 9)))
    filled = P.fill_medians(rows, VARYING, P.medians(rows, VARYING))
    chosen = R.greedy_subset(ranked, P.correlation_pairs(filled, VARYING), None, 0.9)
    return fx.spark.createDataFrame(list(enumerate(chosen, 1)), "position bigint, feature string")


@query("f04_normalised_scores", "feats", f"with {SCORES} select method, feature, round(case when sum(greatest(score,0)) over (partition by method)>0 then greatest(score,0)/sum(greatest(score,0)) over (partition by method) else 0 end,6) as share from cl")
def normalised_scores(fx):
    return tidy(R.normalise_scores(scores(fx), ["method"]).select("method", "feature", "share"))


@query("f05_consensus", "feats", f"""with {SCORES}, s as (select method, feature, greatest(score,0)/sum(greatest(score,0)) over (partition by method) as share from cl),
w as (select feature, max(case when method='fisher' then share end) as f, max(case when method='anova' then share end) as a from s group by feature)
select feature, round(0.4*f+0.4*a,6) as three, round(0.32*f+0.32*a,6) as four, round(0.25*f+0.25*a+0.15*a,6) as five from w""")
def consensus(fx):
    """The three weightings of method scores; methods without scores count as 0."""
    named = scores(fx).select(F.when(F.col("method") == "fisher", "random_forest").otherwise("boosting").alias("method"), "feature", "score")
    as_anova = named.filter("method = 'boosting'").withColumn("method", F.lit("anova_f"))
    three = R.consensus(named, R.CONSENSUS_THREE).select("feature", F.col("combined").alias("three"))
    four = R.consensus(named, R.CONSENSUS_FOUR).select("feature", F.col("combined").alias("four"))
    five = R.consensus(named.unionByName(as_anova), R.CONSENSUS_FIVE).select("feature", F.col("combined").alias("five"))
    return tidy(three.join(four, "feature").join(five, "feature"))


TRIALS = """tr as (select o_custkey%7 as model, o_orderkey as trial, case when o_orderkey%11=0 then 'PRUNED' else 'COMPLETE' end as state, (o_totalprice%1000)/1000 as value from orders)"""


def trials(fx):
    return fx.table("orders").select(
        (F.col("o_custkey") % 7).alias("model"), F.col("o_orderkey").alias("trial"),
        F.when(F.col("o_orderkey") % 11 == 0, "PRUNED").otherwise("COMPLETE").alias("state"), ((F.col("o_totalprice") % 1000) / 1000).alias("value"))


@query("f14_running_best", "", f"""with {TRIALS} select model, trial, round(value,6) as value, round(max(case when state='COMPLETE' then value end) over (partition by model order by trial),6) as best_value from tr""")
def running_best(fx):
    return tidy(L.running_best(trials(fx), ["model"], "trial", "value", "state").select("model", "trial", "value", "best_value"))


@query("f14_best_trial", "", f"""with {TRIALS} select model, trial, round(value,6) as value, n as n_completed from (select *, row_number() over (partition by model order by value desc, trial) as rn,
  count(*) over (partition by model) as n from tr where state='COMPLETE') where rn=1""")
def best_trial(fx):
    return tidy(L.best_trial(trials(fx), ["model"], "trial", "value", "state").select("model", "trial", "value", "n_completed"))
