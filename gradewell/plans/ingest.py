"""Queries over label tables and stored objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.functions import labels as LB
from gradewell.operators import ingest as I
from gradewell.operators import profile as P
from gradewell.operators import resolve as RS
from gradewell.plans.registry import CATALOG
from gradewell.plans.tools import tidy
from gradewell.sources import labels as SL
from gradewell.sources import sinks

query = CATALOG.query

INT_LABEL = "case when trunc(try_cast(raw_label as double)) between 0 and 4 then trunc(try_cast(raw_label as double))::int end"


def raw_labels(fx):
    """A label table as text with fractions, out-of-range and unreadable labels among good ones."""
    return fx.samples.select(
        "image_id", F.when(F.col("image_id").cast("int") % 19 == 0, F.concat("raw_label", F.lit(".7")))
        .when(F.col("image_id").cast("int") % 23 == 0, "9").otherwise(F.col("raw_label")).alias("raw_label"))


RAW = """raw as (select image_id, case when image_id::int%19=0 then raw_label || '.7' when image_id::int%23=0 then '9' else raw_label end as raw_label from samples)"""


@query("a01_scan_labels", "samples", f"with {RAW} select image_id as id, {INT_LABEL} as label, 'labels' as source, ({INT_LABEL}) is not null as label_ok from raw")
def scan_labels(fx):
    table = raw_labels(fx).select(F.col("image_id").alias("Image_ID"), F.col("raw_label").alias("Grade"))
    return SL.scan_labels(table, "labels")


@query("a01_scan_report", "samples", f"""with {RAW}, s as (select {INT_LABEL} as label from raw),
c as (select label, count(*) as n from s group by label)
select 'labels' as source, sum(n)::bigint as n_rows, sum(case when label is not null then n end)::bigint as n_valid,
  '{{' || string_agg(case when label is not null then '"' || label || '":' || n end, ',' order by label) || '}}' as label_counts,
  sum(case when label is null then n else 0 end)=0 as all_valid from c""")
def scan_report(fx):
    table = raw_labels(fx).select("image_id", F.col("raw_label").alias("grade"))
    return SL.scan_report(SL.scan_labels(table, "labels"))


@query("a03_label_layouts", "samples", """
select 'train_images/' || image_id || '.png' as image_path, case when raw_label in ('0','1','2','3') then raw_label::int end as label from samples""")
def label_layouts(fx):
    table = fx.samples.select(F.col("image_id").alias("id_code"), F.col("raw_label").alias("diagnosis"))
    by_id = SL.normalise_layout(table)
    return SL.normalise_layout(by_id.withColumn("label", F.col("label").cast("string")))


@query("a04_folder_labels", "", """
with p as (select '/data/' || case when doc_id%2=0 then 'train/' else '' end || case doc_id%5 when 0 then 'No-DR' when 1 then 'Mild' when 2 then 'severe dr' when 3 then 'PDR' else 'other' end
  || '/' || doc_id || '.png' as path, doc_id from documents)
select path, doc_id::varchar as id, case doc_id%5 when 0 then 'No-DR' when 1 then 'Mild' when 2 then 'severe dr' when 3 then 'PDR' else 'other' end as folder,
  case when doc_id%2=0 then 'train' end as split, case doc_id%5 when 0 then 0 when 1 then 1 when 2 then 3 when 3 then 4 end as label from p""")
def folder_labels(fx):
    d = F.col("doc_id")
    folder = F.when(d % 5 == 0, "No-DR").when(d % 5 == 1, "Mild").when(d % 5 == 2, "severe dr").when(d % 5 == 3, "PDR").otherwise("other")
    split = F.when(d % 2 == 0, "train/").otherwise("")
    paths = fx.table("documents").select(F.concat(F.lit("/data/"), split, folder, F.lit("/"), d.cast("string"), F.lit(".png")).alias("path"))
    return SL.folder_labels(paths)


@query("a06_scan_features", "feats", "select row_id, label, qty_sum, total, coalesce(disc_max, null) as disc_max from feats")
def scan_features(fx):
    from gradewell.sources.features import scan_features as scan
    return scan(fx.feats, ["qty_sum", "total", "disc_max"], keep=["row_id"])


@query("a08_union_reports", "feats", """
select 'by_label' as report, label, null as source, count(*) as n, null::double as mean_total from feats group by label
union all select 'by_source', null, source, null, round(avg(total),2) from feats group by source""")
def union_reports(fx):
    by_label = fx.feats.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("report", F.lit("by_label"))
    by_source = fx.feats.groupBy("source").agg(F.round(F.avg("total"), 2).alias("mean_total")).withColumn("report", F.lit("by_source"))
    return sinks.union_reports([by_label, by_source])


@query("a08_markdown_rows", "feats", """
select 0 as part, '| source | n |' as line union all select 1, '| --- | --- |'
union all select 2, '| ' || source || ' | ' || count(*) || ' |' from feats group by source""")
def markdown_rows(fx):
    return sinks.markdown_rows(fx.feats.groupBy("source").agg(F.count(F.lit(1)).alias("n")))


@query("a07_valid_feedback", "feedback", """
select event_id::varchar as session_id, rating, seconds from feedback where rating between 1 and 5 and seconds>=0""")
def valid_feedback(fx):
    events = fx.feedback.select(
        F.col("event_id").cast("string").alias("session_id"), F.lit(1).alias("image_count"), F.lit(0).alias("retake_count"),
        F.col("seconds").alias("time_to_finish_seconds"), F.lit(None).cast("array<string>").alias("image_quality_warnings"),
        F.lit("referable").alias("result_shown"), F.col("rating").alias("ease_of_use_rating"), F.lit(None).cast("int").alias("clarity_rating"),
        F.lit(None).cast("int").alias("trust_rating"), F.lit(None).cast("string").alias("notes"))
    return sinks.stamped(events).select("session_id", F.col("ease_of_use_rating").alias("rating"), F.col("time_to_finish_seconds").alias("seconds"))


@query("a09_pending_rows", "files", """
select doc_id, sha from files where sha not in (select sha from files where doc_id%3=0)""")
def pending_rows(fx):
    done = fx.files.filter("doc_id % 3 = 0")
    return sinks.pending(fx.files, done, "sha").select("doc_id", "sha")


@query("a10_bad_records", "samples", f"""with {RAW}
select 'labels' as source, image_id as path, raw_label as label, 'label outside the domain' as error from raw where ({INT_LABEL}) is null""")
def bad_records(fx):
    checked = I.valid_labels(raw_labels(fx), "raw_label")
    _, bad = sinks.split_results(checked, "label_ok")
    return bad.select(F.lit("labels").alias("source"), F.col("image_id").alias("path"), F.col("raw_label").alias("label"),
                      F.lit("label outside the domain").alias("error"))


@query("a11_dataset_inventory", "feats files", """
select 'feats' as table_name, count(*) as n_rows, 13 as n_columns, (select '{' || string_agg('"' || label || '":' || n, ',' order by label) || '}'
    from (select label, count(*) as n from feats group by label)) as label_counts, true as has_label, false as has_hash from feats
union all select 'files', count(*), 5, '{}', false, true from files""")
def dataset_inventory(fx):
    from gradewell.operators.inventory import inventory
    return inventory({"feats": fx.feats, "files": fx.files}, "label", "sha")


@query("b03_valid_labels", "samples", f"with {RAW} select image_id, raw_label, {INT_LABEL} as label, ({INT_LABEL}) is not null as label_ok from raw")
def valid_labels(fx):
    return I.valid_labels(raw_labels(fx), "raw_label")


TEXTS = """t as (select doc_id, case doc_id%9 when 0 then ' No-DR ' when 1 then 'Mild NON-proliferative diabetic retinopathy' when 2 then 'severe' when 3 then 'PDR'
  when 4 then '3' when 5 then '7' when 6 then 'unknown/other' when 7 then 'Proliferate  DR' else 'moderate_dr' end as raw from documents)"""


@query("b04_text_labels", "", f"""with {TEXTS}
select doc_id, raw, case doc_id%9 when 0 then 0 when 1 then 1 when 2 then 3 when 3 then 4 when 4 then 3 when 7 then 4 when 8 then 2 end as label,
  replace(translate(lower(trim(raw)),'-/ ','___'),'__','_') as normalised from t""")
def text_labels(fx):
    d = F.col("doc_id") % 9
    raw = (F.when(d == 0, " No-DR ").when(d == 1, "Mild NON-proliferative diabetic retinopathy").when(d == 2, "severe").when(d == 3, "PDR")
           .when(d == 4, "3").when(d == 5, "7").when(d == 6, "unknown/other").when(d == 7, "Proliferate  DR").otherwise("moderate_dr"))
    table = fx.table("documents").select("doc_id", raw.alias("raw"))
    return I.text_labels(table, "raw").select("doc_id", "raw", "label", LB.normalise_text(F.col("raw")).alias("normalised"))


@query("b05_grade_names", "preds", "select row_id, model, case y_pred " + " ".join(
    f"when {k} then '{v}'" for k, v in K.GRADE_NAMES.items()) + " end as grade_name from preds")
def grade_names(fx):
    return fx.preds.select("row_id", "model", LB.grade_name(F.col("y_pred")).alias("grade_name"))


@query("b06_binary_labels", "preds", "select row_id, model, (y_true>=2)::int as positive, (y_true>0)::int as any_finding from preds")
def binary_labels(fx):
    return fx.preds.select("row_id", "model", LB.binary_label(F.col("y_true")).alias("positive"),
                           LB.binary_label(F.col("y_true"), 1).alias("any_finding"))
