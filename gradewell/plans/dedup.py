"""Queries that find and remove duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.operators import dedup as D
from gradewell.operators import governed as G
from gradewell.operators import nearmatch as NM
from gradewell.operators import ranking as R
from gradewell.plans.registry import CATALOG

query = CATALOG.query
VECTOR = ["n_lines", "qty_max", "tax_max"]


@query("d01_content_duplicates", "files",
       "select doc_id, source, sha from (select *, row_number() over (partition by sha order by doc_id) as rn from files) where rn=1")
def content_duplicates(fx):
    return D.keep_first(fx.files.select("doc_id", "source", "sha"), ["sha"], ["doc_id"])


@query("d02_vector_label_duplicates", "feats",
       "select row_id, label from (select *, row_number() over (partition by n_lines, qty_max, tax_max, label order by row_id) as rn from feats) where rn=1")
def vector_label_duplicates(fx):
    return D.dedup_vectors(fx.feats, VECTOR, "row_id").select("row_id", "label")


@query("d03_vector_duplicates", "feats",
       "select row_id, label from (select *, row_number() over (partition by n_lines, qty_max, tax_max order by row_id) as rn from feats) where rn=1")
def vector_duplicates(fx):
    return D.dedup_vectors(fx.feats, VECTOR, "row_id", label=None).select("row_id", "label")


@query("d04_conflicting_vectors", "feats", """
select min(f) as first_key, sum(n)::bigint as n_rows, count(*) as n_labels, string_agg(label::varchar, ',' order by label) as labels
from (select n_lines, qty_max, tax_max, label, min(row_id) as f, count(*) as n from feats group by all) group by n_lines, qty_max, tax_max having count(*)>1""")
def conflicting_vectors(fx):
    return D.conflicting_vectors(fx.feats, VECTOR)


@query("d05_duplicate_members", "feats",
       "select row_id, group_size from (select row_id, count(*) over (partition by n_lines, qty_max, tax_max) as group_size from feats) where group_size>1")
def duplicate_members(fx):
    return D.duplicate_members(fx.feats, VECTOR).select("row_id", "group_size")


@query("d05_duplicate_report", "feats", """
with v as (select *, count(*) over (partition by n_lines, qty_max, tax_max) as a, count(*) over (partition by n_lines, qty_max, tax_max, label) as b,
  row_number() over (partition by n_lines, qty_max, tax_max order by row_id) as ra, row_number() over (partition by n_lines, qty_max, tax_max, label order by row_id) as rb from feats)
select count(*) filter (a>1) as duplicate_feature_rows, count(*) filter (b>1) as exact_duplicate_rows, count(*) filter (rb>1) as removed_with_label,
  count(*) filter (ra>1) as removed_any_label from v""")
def duplicate_report(fx):
    return D.duplicate_report(fx.feats, VECTOR)


@query("d06_distinct_paths", "files", """
with m as (select doc_id, case when doc_id%2=0 then '/Data//IMG_' || n_chars%50 else '/data/img_' || n_chars%50 end as path, n_chars>100 as readable from files)
select min(path) as path from m where readable group by lower(replace(path,'//','/'))""")
def distinct_paths(fx):
    name = (F.col("n_chars") % 50).cast("string")
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/Data//IMG_"), name)).otherwise(F.concat(F.lit("/data/img_"), name))
    manifest = fx.files.select("doc_id", path.alias("path"), (F.col("n_chars") > 100).alias("readable"))
    return D.distinct_paths(manifest).select("path")


PARTS = """cur as (select *, md5(qty_sum || '|' || n_lines) as content from feats where row_id%4<>0),
ext as (select *, md5(qty_sum || '|' || n_lines) as content from feats where row_id%4=0),
u as (select *, 0 as nw from cur union all select *, 1 from ext),
k1 as (select * from (select *, row_number() over (partition by qty_sum, n_lines order by nw, row_id) as r1 from u) where r1=1),
k2 as (select * from (select *, row_number() over (partition by n_lines, qty_max, tax_max order by nw, row_id) as r2 from k1) where r2=1)"""


def parts(fx):
    rows = fx.feats.withColumn("content", F.md5(F.concat_ws("|", F.col("qty_sum").cast("string"), F.col("n_lines").cast("string"))))
    return rows.filter("row_id % 4 <> 0"), rows.filter("row_id % 4 = 0")


@query("d08_append_dedup", "feats", f"with {PARTS} select row_id, label from k2")
def append_dedup(fx):
    current, extra = parts(fx)
    return D.append_dedup(current, extra, VECTOR, "content", "row_id").select("row_id", "label")


@query("d08_growth_report", "feats", f"""with {PARTS}, c as (select k as label, (select count(*) from cur where label=k) as old_count,
  (select count(*) from ext where label=k) as extra_count, (select count(*) from k2 where label=k) as new_count from (select unnest([0,1,2,3,4])::int as k))
select label, old_count, extra_count, new_count, new_count-old_count as increase, round(new_count/(sum(new_count) over ())*100,2) as new_pct,
  (sum(old_count+extra_count-new_count) over ())::bigint as removed from c""")
def growth_report(fx):
    current, extra = parts(fx)
    return D.growth_report(current, extra, D.append_dedup(current, extra, VECTOR, "content", "row_id"))


@query("d10_ordered_distinct", "", """
select doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x)=i), ' ') as kept from (select doc_id, string_split(source || ' ' || lang || ' ' || source || ' ' || lang, ' ') as w from documents)""")
def ordered_distinct(fx):
    words = F.split(F.concat_ws(" ", "source", "lang", "source", "lang"), " ")
    return fx.table("documents").select("doc_id", F.array_join(F.array_distinct(words), " ").alias("kept"))


@query("c09_near_duplicate_pairs", "prints", """
with d as (select label, fp, count(*) as n from prints group by all)
select a.label, a.fp as fp_a, b.fp as fp_b, bit_count(xor(a.fp, b.fp))::int as distance, a.n as n_a, b.n as n_b
from d a join d b on a.label=b.label and a.fp<b.fp and bit_count(xor(a.fp, b.fp))<=2""")
def near_duplicate_pairs(fx):
    return NM.near_pairs(fx.prints, ["label"], "fp", k=2, bits=63)


@query("c09_near_duplicate_totals", "prints", """
with d as (select label, fp, count(*) as n from prints group by all),
p as (select a.label, count(*) as np, sum(a.n*b.n) as nr from d a join d b on a.label=b.label and a.fp<b.fp and bit_count(xor(a.fp, b.fp))<=2 group by a.label)
select d.label, count(*) as n_fingerprints, coalesce(max(np),0) as fingerprint_pairs, sum(n*(n-1)//2)::bigint as copy_pairs,
  (coalesce(max(nr),0) + sum(n*(n-1)//2))::bigint as row_pairs from d left join p on p.label=d.label group by d.label""")
def near_duplicate_totals(fx):
    return NM.near_pair_totals(fx.prints, ["label"], "fp", k=2, bits=63)


def selection_candidates(fx):
    """Documents outside a current table as candidates; length stands in for the quality measures."""
    n = F.col("n_chars")
    rows = fx.prints.filter("doc_id % 7 <> 0").select(
        "doc_id", "label", "source", "sha", "fp", (n > 0).alias("readable"), (n < 30).alias("tiny_or_invalid"), (n >= 60).alias("quality_pass"))
    return rows, fx.prints.filter("doc_id % 7 = 0").select("sha", "label")


def selection(fx):
    candidates, current = selection_candidates(fx)
    counts = {r["label"]: r["count"] for r in candidates.groupBy("label").count().collect()}
    priority = sorted(counts)
    needed = {label: counts[label] * 2 // 5 for label in priority}
    return G.governed_selection(candidates, current, needed, priority, [F.col("doc_id") % 3, F.col("doc_id")], k=2, bits=63)


@query("d07_governed_selection")
def governed_selection(fx):
    return selection(fx).select("doc_id", "label", "selected", "reason")


@query("d07_selection_report")
def selection_report(fx):
    return selection(fx).groupBy("label", F.coalesce("reason", F.lit("selected")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("f15_candidate_rank", "files", """
with c as (select doc_id, case doc_id%4 when 0 then 'Sachin Kumar' when 1 then 'IDRiD grading' when 2 then 'Diabetic_Retinopathy_Balanced' else source end as src,
  '/D/' || case doc_id%3 when 0 then 'Train' when 1 then 'val' else 'test' end || '/' || case when doc_id%5=0 then 'x_AUG_' else 'x' end || doc_id || '.png' as path from files)
select doc_id, row_number() over (order by case src when 'IDRiD grading' then 0 when 'Sachin Kumar' then 1 when 'Diabetic_Retinopathy_Balanced' then 2 else 9 end,
  (doc_id%5=0)::int, doc_id%3, lower(path)) as rank from c""")
def candidate_rank(fx):
    from pyspark.sql import Window
    d = F.col("doc_id")
    source = F.when(d % 4 == 0, "Sachin Kumar").when(d % 4 == 1, "IDRiD grading").when(d % 4 == 2, "Diabetic_Retinopathy_Balanced").otherwise(F.col("source"))
    folder = F.when(d % 3 == 0, "Train").when(d % 3 == 1, "val").otherwise("test")
    stem = F.when(d % 5 == 0, "x_AUG_").otherwise("x")
    path = F.concat(F.lit("/D/"), folder, F.lit("/"), stem, d.cast("string"), F.lit(".png"))
    keys = R.candidate_rank(source, path)
    ranked = fx.files.select("doc_id", F.struct(*keys).alias("key"))
    from gradewell.operators.ordering import global_rank
    return global_rank(ranked, "key").select("doc_id", "rank")
