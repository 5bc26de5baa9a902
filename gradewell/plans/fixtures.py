"""The fixture tables as DataFrames and, word for word, as DuckDB views for the oracle."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions.probability import prediction_features
from gradewell.session import materialize

FEATURES = ["n_lines", "qty_sum", "qty_max", "qty_dup", "price_max", "tax_max", "total",
            "const_one", "near_const", "disc_max"]

# Measurement columns derived from the key of a feature row, beside those taken from its measures.
MEASURES = [
    "exudate_count", "hard_exudate_count", "soft_exudate_count", "hemorrhage_count", "cotton_wool_count",
    "exudate_area", "hard_exudate_area", "soft_exudate_area", "cotton_wool_area", "combined_lesion_area", "fov_area",
    "ma_density", "ma_density_per_retinal_area", "exudate_density", "hard_exudate_coverage_pct", "hemorrhage_density",
    "soft_exudate_coverage_pct", "vessel_density", "vessel_area_ratio", "vessel_length", "vessel_skeleton_length",
    "vessel_complexity_score", "vessel_fragmentation_index", "vessel_tortuosity_mean", "vessel_tortuosity_std",
    "vessel_curvature_mean", "vessel_branchpoint_count", "vessel_branching_count", "vessel_average_width",
    "glcm_contrast", "glcm_homogeneity", "glcm_energy", "glcm_entropy", "glcm_correlation",
    "glcm_contrast_0", "glcm_contrast_45", "glcm_contrast_90", "glcm_contrast_135",
    "glcm_energy_0", "glcm_energy_45", "glcm_energy_90", "glcm_energy_135",
    "lbp_entropy", "lbp_uniform_ratio", "lbp_std", "lbp_mean",
    "hard_exudate_distance_to_macula_mean", "soft_exudate_distance_to_macula_mean",
    "hard_exudate_distance_to_optic_disc_mean", "soft_exudate_distance_to_optic_disc_mean",
    "ma_superior_count", "ma_inferior_count", "ma_nasal_count", "ma_temporal_count",
    "hemorrhage_retina_affected_pct", "quality_contrast", "quality_brightness", "quality_blur_score",
]


def measure_sql(position: int, name: str) -> str:
    """Whole numbers below 40 for counts, tenths below 97 for the rest; a thirteenth of the densities is missing."""
    if name.endswith("_count"):
        return f"cast(mod(mod(row_id * {position + 3}, 41), {position % 5 + 3}) as double) as {name}"
    value = f"cast(mod(row_id * {position + 3} + {position}, 97) as double) / cast(10 as double)"
    if name.endswith("density"):
        return f"case when mod(row_id, 13) = 0 then null else {value} end as {name}"
    return f"{value} as {name}"


MEASURE_SELECT = ", ".join(measure_sql(i, n) for i, n in enumerate(MEASURES))

# Networks of the hybrid table, and the embedding columns of each.
NETWORKS = ("m1", "m2")
EMBEDDED = 12

# Symbols whose frequencies are compared pairwise to form a 63-bit difference fingerprint.
FINGERPRINT_SYMBOLS = "abcdefghijklmnopqrstuvwxyz .,;:!?-'\"()0123456789ABCDEFGHIJKLMNOPQ"[:64]


class Fixtures:
    """Lazily built tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def feats(self) -> DataFrame:
        lines = self.table("lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(
            F.count(F.lit(1)).cast("double").alias("n_lines"),
            F.sum("l_quantity").alias("qty_sum"),
            F.max("l_quantity").alias("qty_max"),
            F.max("l_extendedprice").alias("price_max"),
            F.max("l_tax").alias("tax_max"),
            F.max("l_discount").alias("disc"),
        )
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("row_id"),
            (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("label"),
            F.col("o_orderstatus").alias("source"),
            F.col("o_totalprice").alias("total"),
        )
        key = F.col("row_id")
        return orders.join(lines, "row_id").select(
            "row_id", "label", "source", "n_lines", "qty_sum", "qty_max",
            (F.col("qty_sum") * 2).alias("qty_dup"), "price_max", "tax_max", "total",
            F.lit(1.0).alias("const_one"),
            F.when(key % 499 == 0, 1.0).otherwise(0.0).alias("near_const"),
            F.when(key % 13 == 0, None).otherwise(F.col("disc")).alias("disc_max"),
        )

    @cached_property
    def feats_once(self) -> DataFrame:
        """The feature table written once, for operators that read their input several times."""
        return materialize(self.feats)

    @cached_property
    def gaps(self) -> DataFrame:
        """The feature table with labels and sources that are NULL in places."""
        key = F.col("row_id")
        return self.feats.withColumns({
            "label": F.when(key % 10 != 0, F.col("label")), "source": F.when(key % 7 != 0, F.col("source"))})

    @cached_property
    def preds_gaps(self) -> DataFrame:
        """Predictions of which a third name no model."""
        return self.preds.withColumn("model", F.when(F.col("row_id") % 10 >= 3, F.col("model")))

    @cached_property
    def measures(self) -> DataFrame:
        """Feature rows with named measurement columns."""
        return self.feats.selectExpr(
            "row_id", "label", "n_lines as ma_count", "qty_sum as ma_area", "price_max as hemorrhage_area",
            *[measure_sql(i, n) for i, n in enumerate(MEASURES)])

    @cached_property
    def preds(self) -> DataFrame:
        models = F.array(
            F.struct(F.lit("m1").alias("model"), F.lit(7).alias("f")),
            F.struct(F.lit("m2").alias("model"), F.lit(3).alias("f")),
        )
        base = self.table("orders").select(
            F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("c"),
            F.col("o_orderstatus").alias("source"),
            (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("y_true"),
            F.inline(models),
        )
        row, c, f, y = (F.col(name) for name in ("row_id", "c", "f", "y_true"))
        guessed = base.withColumn(
            "y_pred",
            F.when((row * f + c) % 10 < 6, y).otherwise((row + c * f) % 5).cast("int"),
        )

        def weight(k: int, base_term: Column) -> Column:
            bonus = F.when(F.col("y_pred") == k, 5).otherwise(0)
            return (F.lit(1) + base_term % 3 + bonus).cast("double").alias(f"w{k}")

        return guessed.select(
            "row_id", "model", "source", "y_true", "y_pred",
            weight(0, row), weight(1, row + 1), weight(2, row + 2), weight(3, c), weight(4, c + 1),
            (((row * 37 + c * f) % 800 + F.when(y >= 2, 200).otherwise(0)).cast("double") / 1000.0)
            .alias("score"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """``preds`` with the weights turned into a probability array."""
        weights = [F.col(f"w{k}") for k in range(5)]
        total = weights[0] + weights[1] + weights[2] + weights[3] + weights[4]
        return self.preds.select(
            "row_id", "model", "source", "y_true", "y_pred",
            F.array(*[w / total for w in weights]).alias("prob"), "score",
        )

    @cached_property
    def hybrid(self) -> DataFrame:
        """Feature rows with the predictions of two networks and, from each, half of an embedding in short columns."""
        said = self.predictions.select("row_id", "model", "prob", *[c.alias(n) for n, c in prediction_features(F.col("prob")).items()])
        wide = said.groupBy("row_id").agg(*[
            F.max(F.when(F.col("model") == m, c)).alias(f"cnn_{m}__{n}") for m in NETWORKS for n, c in
            {**{f"prob_class_{k}": F.col("prob")[k] for k in range(5)}, "referable_probability": F.col("positive_probability"),
             **{n: F.col(n) for n in ("max_probability", "entropy", "margin")}}.items()])
        vectors = self.table("embeddings").select(F.col("vec_id").alias("_vec"), *[
            F.col("embedding")[i * EMBEDDED + j].cast("double").alias(f"cnn_embed_{m}_{j:03d}") for i, m in enumerate(NETWORKS) for j in range(EMBEDDED)])
        count = vectors.agg(F.count(F.lit(1)).alias("_vectors"))
        keyed = self.feats.crossJoin(F.broadcast(count)).withColumn("_vec", F.col("row_id") % F.col("_vectors"))
        return keyed.join(vectors, "_vec").join(wide, "row_id").drop("_vec", "_vectors")

    @cached_property
    def every_file(self) -> DataFrame:
        suffix = F.when(F.col("doc_id") % 3 == 0, ".jpg").when(F.col("doc_id") % 3 == 1, ".png").otherwise("")
        return self.table("documents").select(
            "doc_id", "source", F.concat(F.col("doc_id").cast("string"), suffix).alias("file_name"),
            F.sha2("text", 256).alias("sha"), "n_chars",
        )

    @cached_property
    def files(self) -> DataFrame:
        """Files with gaps, so that some ids of the resolution joins have none."""
        return self.every_file.filter("doc_id % 11 <> 0")

    @cached_property
    def samples(self) -> DataFrame:
        return self.table("labels").select(
            F.col("doc_id").cast("string").alias("image_id"),
            F.when(F.col("doc_id") % 17 == 0, "No-DR")
            .otherwise((F.col("quality") + 2 * F.col("toxic")).cast("string")).alias("raw_label"),
        )

    @cached_property
    def cands(self) -> DataFrame:
        bits = F.expr(
            "aggregate(transform(sequence(0, 62), i -> if(embedding[i] > 0, shiftleft(1L, i), 0L)), 0L, (x, y) -> x + y)"
        )
        return self.table("embeddings").select(
            "vec_id", (F.col("label") % 5).alias("label"), (F.col("vec_id") % 3).cast("int").alias("src_rank"),
            bits.alias("fp"),
        )

    @cached_property
    def prints(self) -> DataFrame:
        """Documents with a 63-bit difference fingerprint of their symbol frequencies, counted in one pass per text."""
        symbols = np.frombuffer(FINGERPRINT_SYMBOLS.encode(), np.uint8)

        @F.pandas_udf("bigint")
        def bits(texts: pd.Series) -> pd.Series:
            counts = np.array([np.bincount(np.frombuffer((t or "").encode(), np.uint8), minlength=256)[symbols] for t in texts]).reshape(-1, 64)
            return pd.Series((counts[:, :-1] > counts[:, 1:]) @ (1 << np.arange(63)))

        return self.table("documents").select(
            "doc_id", F.col("lang").alias("label"), "source", "n_chars", F.sha2("text", 256).alias("sha"), bits("text").alias("fp"))

    @cached_property
    def shots(self) -> DataFrame:
        bad = F.col("event_type") == "error"
        return self.table("events").select(
            "event_id", "user_id", "ts",
            F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string")).alias("session_id"),
            (~bad).alias("quality_ok"),
            F.when(bad, None).otherwise(F.least(F.col("value"), F.lit(200.0)) / 200.0).alias("p_ref"),
            F.when(bad, None).otherwise((F.col("event_id") % 5).cast("int")).alias("grade"),
        )

    @cached_property
    def feedback(self) -> DataFrame:
        return self.table("events").filter("event_type = 'purchase'").select(
            "event_id", "ts",
            (1 + F.regexp_extract("props", "[0-9]+", 0).cast("int") % 5).alias("rating"),
            F.col("value").alias("seconds"),
        )

    @cached_property
    def regions(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("image_id"), F.col("l_returnflag").alias("kind"),
            F.col("l_quantity").alias("x"), (F.col("l_linenumber").cast("double") * 7).alias("y"),
            F.col("l_extendedprice").alias("area"),
        )


def _print_bits() -> str:
    counts = ", ".join(
        "length(text) - length(replace(text, '{}', ''))".format("''" if s == "'" else s) for s in FINGERPRINT_SYMBOLS
    )
    return (
        "select doc_id, lang as label, source, n_chars, sha256(text) as sha, "
        "cast(list_sum(list_transform(range(0, 63), lambda i: case when freq[i + 1] > freq[i + 2] "
        f"then (1::bigint << i) else 0::bigint end)) as bigint) as fp from (select *, [{counts}] as freq from documents)"
    )


def _hybrid_sql() -> str:
    said = [*[(f"prob_class_{k}", f"prob[{k + 1}]") for k in range(5)], ("referable_probability", "prob[3]+prob[4]+prob[5]"), ("max_probability", "list_max(prob)"),
            ("entropy", "list_sum(list_transform(prob, lambda p: -p*ln(greatest(p,1e-9::double))))"), ("margin", "list_reverse_sort(prob)[1]-list_reverse_sort(prob)[2]")]
    wide = ", ".join(f"max(case when model='{m}' then {sql} end) as cnn_{m}__{n}" for m in NETWORKS for n, sql in said)
    vectors = ", ".join(f"embedding[{i * EMBEDDED + j + 1}]::double as cnn_embed_{m}_{j:03d}" for i, m in enumerate(NETWORKS) for j in range(EMBEDDED))
    return f"""
select f.*, w.* exclude (row_id), e.* exclude (vec_id) from feats f join (select row_id, {wide} from predictions group by row_id) w on w.row_id=f.row_id
  join (select vec_id, {vectors} from embeddings) e on e.vec_id = f.row_id % (select count(*) from embeddings)"""


VIEWS = {
    "feats": """
select o.o_orderkey as row_id, cast(substr(o.o_orderpriority,1,1) as int)-1 as label, o.o_orderstatus as source,
  cast(count(*) as double) as n_lines, sum(l.l_quantity) as qty_sum, max(l.l_quantity) as qty_max,
  sum(l.l_quantity)*2 as qty_dup, max(l.l_extendedprice) as price_max, max(l.l_tax) as tax_max,
  max(o.o_totalprice) as total, cast(1 as double) as const_one,
  cast(case when mod(o.o_orderkey,499)=0 then 1 else 0 end as double) as near_const,
  case when mod(o.o_orderkey,13)=0 then null else max(l.l_discount) end as disc_max
from orders o join lineitem l on l.l_orderkey=o.o_orderkey
group by o.o_orderkey, o.o_orderpriority, o.o_orderstatus""",
    "gaps": """
select * replace (case when mod(row_id,10)=0 then null else label end as label, case when mod(row_id,7)=0 then null else source end as source) from feats""",
    "preds_gaps": """
select * replace (case when mod(row_id,10)<3 then null else model end as model) from preds""",
    "copied": "select *, qty_sum as qty_same, qty_sum as qty_again from feats",
    "measures": f"""
select row_id, label, n_lines as ma_count, qty_sum as ma_area, price_max as hemorrhage_area, {MEASURE_SELECT} from feats""",
    "preds": """
select row_id, model, source, y_true, y_pred,
  cast(1+mod(row_id,3)+case when y_pred=0 then 5 else 0 end as double) as w0,
  cast(1+mod(row_id+1,3)+case when y_pred=1 then 5 else 0 end as double) as w1,
  cast(1+mod(row_id+2,3)+case when y_pred=2 then 5 else 0 end as double) as w2,
  cast(1+mod(c,3)+case when y_pred=3 then 5 else 0 end as double) as w3,
  cast(1+mod(c+1,3)+case when y_pred=4 then 5 else 0 end as double) as w4,
  cast(mod(row_id*37+c*f,800) + case when y_true>=2 then 200 else 0 end as double)/1000.0 as score
from (select b.*, cast(case when mod(row_id*f+c,10)<6 then y_true else mod(row_id+c*f,5) end as int) as y_pred
  from (select o_orderkey as row_id, o_custkey as c, o_orderstatus as source,
      cast(substr(o_orderpriority,1,1) as int)-1 as y_true, m.model, m.f
    from orders cross join (select 'm1' as model, 7 as f union all select 'm2' as model, 3 as f) m) b) p""",
    "predictions": """
select row_id, model, source, y_true, y_pred,
  list_transform([w0,w1,w2,w3,w4], lambda w: w/(w0+w1+w2+w3+w4)) as prob, score from preds""",
    "hybrid": _hybrid_sql(),
    "files": """
select doc_id, source, concat(cast(doc_id as varchar), case mod(doc_id,3) when 0 then '.jpg' when 1 then '.png' else '' end) as file_name,
  sha256(text) as sha, n_chars from documents where mod(doc_id,11)<>0""",
    "every_file": """
select doc_id, source, concat(cast(doc_id as varchar), case mod(doc_id,3) when 0 then '.jpg' when 1 then '.png' else '' end) as file_name,
  sha256(text) as sha, n_chars from documents""",
    "samples": """
select cast(doc_id as varchar) as image_id, case when mod(doc_id,17)=0 then 'No-DR' else cast(quality+2*toxic as varchar) end as raw_label
from labels""",
    "cands": """
select vec_id, label % 5 as label, cast(vec_id % 3 as int) as src_rank,
  cast(list_sum(list_transform(range(0,63), lambda i: case when embedding[i+1]>0 then (1::bigint << i) else 0::bigint end)) as bigint) as fp
from embeddings""",
    "prints": _print_bits(),
    "shots": """
select event_id, user_id, ts, concat(cast(user_id as varchar),'-',cast(cast(ts as date) as varchar)) as session_id,
  event_type<>'error' as quality_ok, case when event_type='error' then null else least(value,200.0)/200.0 end as p_ref,
  case when event_type='error' then null else cast(mod(event_id,5) as int) end as grade
from events""",
    "feedback": """
select event_id, ts, 1+mod(cast(regexp_extract(props,'[0-9]+',0) as int),5) as rating, value as seconds
from events where event_type='purchase'""",
    "regions": """
select l_orderkey as image_id, l_returnflag as kind, l_quantity as x, cast(l_linenumber as double)*7 as y, l_extendedprice as area
from lineitem""",
}
_NEEDS = {"hybrid": ["feats", "preds", "predictions"], "predictions": ["preds"], "measures": ["feats"], "gaps": ["feats"], "copied": ["feats"], "preds_gaps": ["preds"]}


def oracle(views: str, body: str) -> str:
    """``body`` preceded by the named views as common table expressions."""
    names: list[str] = []
    for name in views.split():
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in names:
                names.append(needed)
    ctes = [f"{name} as materialized ({VIEWS[name]})" for name in names]
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(ctes + [body[15:]])
    if body.lower().startswith("with "):
        body = body[5:]
        return "with " + ",\n".join(ctes + [body]) if ctes else "with " + body
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body
