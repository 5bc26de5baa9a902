"""Queries that join label tables, objects and features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gradewell.functions.decisions import PARAM_NAMES, ScoreParams
from gradewell.operators import resolve as RS
from gradewell.plans.fixtures import FEATURES
from gradewell.plans.registry import CATALOG
from gradewell.plans.tools import tidy

query = CATALOG.query

# Ids: plain, with extension, with an unknown object; files also in a second extension and an upper-case one.
ASKED = """asked as (select image_id, case when image_id::int%5=0 then image_id || '.jpg' else image_id end as wanted from samples),
stock as (select file_name from files union all select doc_id || '.tiff' from files where doc_id%4=0
  union all select doc_id || '.JPG' from files where doc_id%6=0 union all select doc_id || '.jpg.png' from files where doc_id%10=0)"""


def asked(fx):
    return fx.samples.select("image_id", F.when(F.col("image_id").cast("int") % 5 == 0, F.concat("image_id", F.lit(".jpg")))
                             .otherwise(F.col("image_id")).alias("wanted"))


def stock(fx):
    def extra(suffix, n):
        return fx.files.filter(F.col("doc_id") % n == 0).select(F.concat(F.col("doc_id").cast("string"), F.lit(suffix)).alias("file_name"))
    return reduce(lambda a, b: a.unionByName(b), [fx.files.select("file_name"), extra(".tiff", 4), extra(".JPG", 6), extra(".jpg.png", 10)])


RESOLVED = f"""{ASKED}, st as (select file_name, regexp_extract(file_name,'(\\.[^.]*)$',1) as ext from stock),
kn as (select file_name, ext, file_name[:length(file_name)-length(ext)] as stem,
  case when lower(ext)=ext then list_position(['.bmp','.jpeg','.jpg','.png','.tif','.tiff'], ext) else 7 end as rk
  from st where lower(ext) in ('.bmp','.jpeg','.jpg','.png','.tif','.tiff')),
best as (select stem, arg_min(file_name, rk*1000000 + 0) as f, min(rk) as rk from (select stem, rk, min(file_name) as file_name from kn group by stem, rk) group by stem),
res as (select a.image_id, a.wanted, case when a.wanted like '%.jpg' and e.file_name is not null then e.file_name else b.f end as file_name,
  case when a.wanted like '%.jpg' and e.file_name is not null then 'exact' when b.f is null then null when b.rk<=6 then 'preferred' else 'other' end as how
  from asked a left join (select distinct file_name from kn) e on e.file_name=a.wanted left join best b on b.stem=a.wanted)"""


@query("c01_resolve_files", "samples files", f"with {RESOLVED} select * from res")
def resolve_files(fx):
    return RS.resolve_files(asked(fx), stock(fx), "wanted")


@query("c02_missing_report", "samples files", f"""with {RESOLVED}, m as (select wanted from res where file_name is null)
select count(*) as n_missing, (select string_agg(wanted, ',' order by wanted) from (select wanted from m order by wanted limit 20)) as preview from m""")
def missing_report(fx):
    return RS.missing_report(RS.resolve_files(asked(fx), stock(fx), "wanted"), "wanted")


@query("c03_resume", "feats", "select row_id from feats where row_id not in (select o_orderkey from orders where o_totalprice>200000)")
def resume(fx):
    done = fx.table("orders").filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("row_id"))
    kept, _ = RS.exclude_known(fx.feats.select("row_id"), done, "row_id")
    return kept


@query("c04_exclude_current", "files", """
select doc_id, sha in (select sha from files where doc_id%5=0) as in_current from files where doc_id%5<>0""")
def exclude_current(fx):
    current = fx.files.filter("doc_id % 5 = 0")
    kept, rejected = RS.exclude_known(fx.files.filter("doc_id % 5 <> 0").select("doc_id", "sha"), current, "sha")
    return kept.select("doc_id", F.lit(False).alias("in_current")).unionByName(rejected.select("doc_id", F.lit(True).alias("in_current")))


@query("c05_one_to_one_merge", "feats", "select row_id, label, qty_sum, total, price_max from feats")
def one_to_one_merge(fx):
    left = fx.feats.select("row_id", "label", "qty_sum", "total")
    right = fx.feats.select("row_id", "label", "price_max")
    return RS.merge_one_to_one(left, right, ["row_id", "label"])


@query("c05_merge_report", "feats", """
with l as (select row_id, label from feats where row_id%10<8), r as (select row_id, label from feats where row_id%10>2 union all select row_id, label from feats where row_id%100=5)
select count(*) filter (l>0 and r>0) as n_both, count(*) filter (r=0) as n_left_only, count(*) filter (l=0) as n_right_only, count(*) filter (l>1 or r>1) as n_repeated
from (select row_id, label, sum(a) as l, sum(b) as r from (select *, 1 as a, 0 as b from l union all select *, 0, 1 from r) group by all)""")
def merge_report(fx):
    keys = fx.feats.select("row_id", "label")
    right = keys.filter("row_id % 10 > 2").unionByName(keys.filter("row_id % 100 = 5"))
    return RS.merge_report(keys.filter("row_id % 10 < 8"), right, ["row_id", "label"])


@query("c06_align_optional", "feats", """
select f.row_id, f.total, coalesce(o.disc_max,0) as disc_max, coalesce(o.price_max,0) as price_max
from feats f left join (select * from feats where qty_max>45) o on o.row_id=f.row_id""")
def align_optional(fx):
    optional = fx.feats.filter("qty_max > 45")
    return RS.align_optional(fx.feats.select("row_id", "total"), optional, "row_id", ["disc_max", "price_max"])


@query("c07_rows_for_manifest", "feats", """
select m.row_id, 'holdout' as split, f.label, f.total from (select o_orderkey as row_id from orders where o_totalprice between 100000 and 150000) m join feats f on f.row_id=m.row_id""")
def rows_for_manifest(fx):
    manifest = fx.table("orders").filter("o_totalprice between 100000 and 150000").select(
        F.col("o_orderkey").alias("row_id"), F.lit("holdout").alias("split"))
    return RS.rows_for_manifest(fx.feats.select("row_id", "label", "total"), manifest, "row_id")


GRID = {"exudate_weight": [1.0, 1.4, 2.0], "grade2": [6.0, 8.0], "grade3": [18.0, 22.0]}


@query("c10_parameter_grid", "feats", """
with g as (select row_number() over (order by a,b,c)-1 as combo, a, b, c from (select unnest([1.0,1.4,2.0]::double[]) as a) cross join (select unnest([6.0,8.0]::double[]) as b)
  cross join (select unnest([18.0,22.0]::double[]) as c)),
s as (select combo, label, n_lines + mod(row_id,4)*a + mod(row_id,3)*5.0 as sc, n_lines+mod(row_id,4) as les, b, c from feats cross join g)
select combo::int as combo, count(*) as n_rows, sum((case when les=0 and sc<1 then 0 when sc>=c then 3 when sc>=b then 2 when sc>=1 or les>0 then 1 else 0 end = label)::int)::bigint as n_agree from s group by combo""")
def parameter_grid(fx):
    from gradewell.models.search import score_grid
    key = F.col("row_id")
    zero = F.lit(0.0)
    findings = {"ma_count": F.col("n_lines"), "exudate_count": key % 4, "exudate_quadrants": key % 3,
                "pathology_area_index": zero, "vessel_density": zero, "glcm_contrast": zero}
    graded = score_grid(fx.feats, findings, ScoreParams(), GRID)
    return graded.groupBy("combo").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("grade") == F.col("label")).alias("n_agree"))


@query("c11_union_sources", "feats files", """
select row_id::varchar as id, source, label, null::varchar as sha from feats
union all select doc_id::varchar, source, null, sha from files""")
def union_sources(fx):
    from gradewell.sources.sinks import union_reports
    a = fx.feats.select(F.col("row_id").cast("string").alias("id"), "source", "label")
    b = fx.files.select(F.col("doc_id").cast("string").alias("id"), "source", "sha")
    return union_reports([a, b])


@query("c12_name_sets", "", """
select n_name as name, n_regionkey as region, len(list_intersect(['A','E','I'], string_split(n_name,''))) as n_common,
  case when exists (select 1 from supplier where s_nationkey=n_nationkey) and exists (select 1 from customer where c_nationkey=n_nationkey) then 'both' else 'one' end as side from nation""")
def name_sets(fx):
    nations = fx.table("nation")
    suppliers = fx.table("supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    customers = fx.table("customer").select(F.col("c_nationkey").alias("n_nationkey"))
    both = suppliers.intersect(customers).withColumn("_both", F.lit(True))
    vowels = F.array(F.lit("A"), F.lit("E"), F.lit("I"))
    common = F.array_intersect(vowels, F.split("n_name", ""))
    return nations.join(both, "n_nationkey", "left").select(
        F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.size(common).cast("bigint").alias("n_common"),
        F.when(F.col("_both"), "both").otherwise("one").alias("side"))
