"""Queries over splits, folds and samples of the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.operators import metrics as M
from gradewell.operators import splits as S
from gradewell.plans.registry import CATALOG
from gradewell.plans.tools import tidy
from gradewell.session import materialize

query = CATALOG.query


def split_sql(test: str, validation: str, source: str = "feats") -> str:
    """Hash-ordered largest-remainder split as the CTE ``sp``."""
    return f"""o as (select *, row_number() over (partition by label order by md5('42|' || row_id), row_id) as rn from {source}),
n0 as (select label, count(*) as n from {source} group by label),
t1 as (select label, n, sum(n) over ()::bigint as tot, ceil(sum(n) over () * {test}::double)::bigint as d from n0),
t2 as (select *, (n*d)//tot as b, (n*d)%tot as l from t1),
t3 as (select label, n, b + (row_number() over (order by l desc, label nulls first) <= d - sum(b) over ())::int as n_test from t2),
v1 as (select *, (n-n_test) as r, sum(n-n_test) over ()::bigint as tot, ceil(sum(n-n_test) over () * ({validation})::double)::bigint as d from t3),
v2 as (select *, (r*d)//tot as b, (r*d)%tot as l from v1),
v3 as (select label, n_test, n_test + b + (row_number() over (order by l desc, label nulls first) <= d - sum(b) over ())::int as n_both from v2),
sp as (select o.*, case when rn<=n_test then 'test' when rn<=n_both then 'val' else 'train' end as split from o join v3 on o.label is not distinct from v3.label)"""


def keys(fx):
    """Key and label, written once: cut points take several passes over them."""
    return materialize(fx.feats.select("row_id", "label"))


@query("g01_split_80_20", "feats", f"with {split_sql('0.2', '0.2')} select row_id, label, split from sp")
def split_80_20(fx):
    return S.stratified_split(keys(fx), ["label"], "row_id", 0.2, 0.2)


@query("g02_split_70_15_15", "feats",
       f"with {split_sql('0.15', '0.15::double/0.85::double')} select row_id, label, split from sp")
def split_70_15_15(fx):
    return S.stratified_split(keys(fx), ["label"], "row_id", 0.15, 0.15 / 0.85)


@query("g03_stratified_folds", "feats", """
select row_id, label, (ntile(5) over (partition by label order by md5('42|' || row_id), row_id) - 1)::int as fold from feats""")
def stratified_folds(fx):
    return S.stratified_folds(keys(fx), ["label"], "row_id", 5)


@query("g01_null_labels", "gaps", f"with {split_sql('0.2', '0.2', 'gaps')} select row_id, label, split from sp")
def split_null_labels(fx):
    """Rows without a label are a stratum like any other."""
    return S.stratified_split(materialize(fx.gaps.select("row_id", "label")), ["label"], "row_id", 0.2, 0.2)


@query("g03_null_strata", "gaps", """
select row_id, label, source, (ntile(3) over (partition by label, source order by md5('42|' || row_id), row_id) - 1)::int as fold from gaps""")
def folds_null_strata(fx):
    return S.stratified_folds(materialize(fx.gaps.select("row_id", "label", "source")), ["label", "source"], "row_id", 3)


@query("f07_null_labels", "gaps", """
select row_id, label from (select *, row_number() over (partition by label order by md5('42|' || row_id), row_id) as rn from gaps) where rn<=900//6""")
def cap_null_labels(fx):
    return S.stratified_cap(materialize(fx.gaps.select("row_id", "label")), "label", "row_id", 900)


@query("f08_null_labels", "gaps", """
with h as (select row_id, label, md5('42|' || row_id) as h from gaps),
a as (select *, row_number() over (partition by label order by h, row_id) <= 900//6 as first from h),
b as (select *, row_number() over (partition by first order by h, row_id) as rn from a)
select row_id, label from b where first or rn <= 900 - (select count(*) from b where first)""")
def balanced_null_labels(fx):
    return S.balanced_sample(materialize(fx.gaps.select("row_id", "label")), "label", "row_id", 900)


@query("g05_split_report", "feats", f"""with {split_sql('0.2', '0.2')}
select split, label, count(*) as n, sum(count(*)) over (partition by split)::bigint as split_size,
  round(count(*)/sum(count(*)) over (partition by split),6) as share from sp group by split, label""")
def split_report(fx):
    split = S.stratified_split(keys(fx), ["label"], "row_id", 0.2, 0.2)
    return tidy(S.split_report(split, "label"))


FOLDS = """fm as (select model, (ntile(5) over (partition by model, y_true order by md5('42|' || row_id), row_id) - 1) as fold, * exclude (model) from preds),
m as (select model, fold, avg((y_true=y_pred)::int::double) as accuracy, avg(abs(y_true-y_pred)::double) as mean_abs_error from fm group by model, fold),
l as (select model, 'accuracy' as metric, accuracy as v from m union all select model, 'mean_abs_error', mean_abs_error from m)"""


def fold_metrics(fx):
    folds = S.stratified_folds(fx.preds, ["model", "y_true"], "row_id", 5)
    return M.evaluate(folds, ["model", "fold"]).select("model", "fold", "accuracy", "mean_abs_error")


@query("g07_fold_summary", "preds", f"""with {FOLDS}
select model, metric, round(avg(v),6) as mean, round(stddev_pop(v),6) as std from l group by model, metric""")
def fold_summary(fx):
    return tidy(S.fold_summary(fold_metrics(fx), ["model"], ["accuracy", "mean_abs_error"]))


@query("g08_confidence_interval", "preds", f"""with {FOLDS}
select model, metric, round(avg(v),6) as mean, round(stddev_samp(v),6) as std,
  round(avg(v)-1.96::double*stddev_samp(v)/sqrt(count(*)),6) as ci95_low, round(avg(v)+1.96::double*stddev_samp(v)/sqrt(count(*)),6) as ci95_high
from l group by model, metric""")
def confidence_interval(fx):
    return tidy(S.confidence_interval(fold_metrics(fx), ["model"], ["accuracy", "mean_abs_error"]))


@query("g09_group_split", "", """
with g as (select distinct o_custkey as grp from orders),
r as (select grp, row_number() over (order by md5('42|' || grp), grp) as rn, count(*) over () as n from g),
c as (select *, ceil(n*0.2::double)::bigint as a from r)
select o_orderkey as row_id, o_custkey as grp, case when rn<=a then 'test' when rn<=a+ceil((n-a)*0.2::double) then 'val' else 'train' end as split
from orders join c on o_custkey=grp""")
def group_split(fx):
    orders = fx.table("orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("grp"))
    return S.group_split(orders, "grp")


@query("c08_split_overlaps", "feats", f"""with {split_sql('0.2', '0.2')},
p as (select * from (values ('train','val'),('train','test'),('val','test')) as v(left_split, right_split))
select left_split, right_split, count(b.row_id) as n_shared, count(b.row_id)=0 as disjoint
from p join sp a on a.split=left_split left join sp b on b.split=right_split and b.row_id=a.row_id group by left_split, right_split""")
def split_overlaps(fx):
    split = S.stratified_split(keys(fx), ["label"], "row_id", 0.2, 0.2)
    return S.split_overlaps(split, "row_id")


@query("c08_content_overlaps", "files", """
with s as (select sha, case when doc_id%3=0 then 'test' when doc_id%3=1 then 'val' else 'train' end as split from files),
d as (select distinct sha, split from s),
p as (select * from (values ('train','val'),('train','test'),('val','test')) as v(left_split, right_split))
select left_split, right_split, count(b.sha) as n_shared, count(b.sha)=0 as disjoint
from p join d a on a.split=left_split left join d b on b.split=right_split and b.sha=a.sha group by left_split, right_split""")
def content_overlaps(fx):
    by_id = F.when(F.col("doc_id") % 3 == 0, "test").when(F.col("doc_id") % 3 == 1, "val").otherwise("train")
    return S.split_overlaps(fx.files.select("sha", by_id.alias("split")), "sha")


@query("m09_class_weights", "feats", """
with c as (select label, count(*) as n from feats group by label)
select label, n, round(sum(n) over ()::double/(count(*) over ()*n),6) as weight from c""")
def class_weights(fx):
    return tidy(S.class_weights(fx.feats, "label"))


@query("m09_positive_weight", "feats",
       "select round(sum((label<2)::int)::double/sum((label>=2)::int),6) as pos_weight from feats")
def positive_weight(fx):
    return tidy(S.positive_weight(fx.feats, F.col("label") >= 2))


@query("f06_first_per_class", "feats", """
select row_id, label from (select row_id, label, row_number() over (partition by label order by row_id) as rn from feats) where rn<=20""")
def first_per_class(fx):
    return S.first_per_class(fx.feats.select("row_id", "label"), "label", [F.col("row_id")], 20)


HASHED = "h as (select row_id, label, md5('42|' || row_id) as h from feats)"


@query("f07_stratified_cap", "feats", f"""with {HASHED}
select row_id, label from (select *, row_number() over (partition by label order by h, row_id) as rn from h) where rn<=1000//5""")
def stratified_cap(fx):
    return S.stratified_cap(keys(fx), "label", "row_id", 1000)


@query("f08_balanced_sample", "", """
with h as (select doc_id, lang, md5('42|' || doc_id) as h from documents),
k as (select count(distinct lang) as k, count(*)*4//5 as lim from h),
a as (select *, row_number() over (partition by lang order by h, doc_id) <= (select greatest(1, lim//k) from k) as first from h),
b as (select *, row_number() over (partition by first order by h, doc_id) as rn from a)
select doc_id, lang from b where first or rn <= (select lim from k) - (select count(*) from b where first)""")
def balanced_sample(fx):
    docs = fx.table("documents").select("doc_id", "lang")
    return S.balanced_sample(docs, "lang", "doc_id", docs.count() * 4 // 5)


@query("f09_hash_sample", "feats", f"with {HASHED} select row_id, label from h order by h, row_id limit 500")
def hash_sample(fx):
    return S.sample_rows(keys(fx), "row_id", 500)
