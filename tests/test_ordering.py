import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from gradewell.operators import metrics as M
from gradewell.operators import profile as P
from gradewell.operators import splits as S
from gradewell.operators.ordering import cumulative_by_value, global_rank, hash_order, hash_ranked


def test_hash_rank_equals_global_row_number(spark, fx):
    ranked = hash_ranked(fx.feats.select("row_id", "label"), ["label"], "row_id", 42)
    w = Window.partitionBy("label").orderBy(hash_order(42, "row_id"), "row_id")
    assert ranked.withColumn("want", F.row_number().over(w)).filter("hash_rank <> want").count() == 0


def test_global_rank(spark):
    ids = list(range(500))
    random.Random(1).shuffle(ids)
    table = spark.createDataFrame([(i,) for i in ids], "v int").repartition(7)
    assert global_rank(table, "v").filter("rank <> v + 1").count() == 0


def test_cumulative_counts_with_skewed_values(spark):
    rng = np.random.default_rng(0)
    values = [float(v) for v in np.concatenate([rng.exponential(1e-4, 3000), rng.uniform(0, 1, 500), np.full(1500, 0.5)])]
    table = spark.createDataFrame([("g", v, 1) for v in values], "g string, v double, n long")
    out = cumulative_by_value(table, ["g"], "v", ["n"]).collect()
    ordered = np.sort(values)
    assert sum(r["n"] for r in out) == len(values)
    assert all(r["n_below"] == np.searchsorted(ordered, r["v"]) for r in out)


def test_auc_equals_all_pairs_and_mirrors(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 400), np.round(rng.uniform(0, 1, 400), 2)
    table = spark.createDataFrame([("m", int(a), float(b), float(-b)) for a, b in zip(y, s)], "model string, y int, s double, t double")
    wins = sum((p > n) + 0.5 * (p == n) for p in s[y == 1] for n in s[y == 0]) / ((y == 1).sum() * (y == 0).sum())
    area = M.auc(table, ["model"], "s", F.col("y") == 1).first()["auc"]
    assert abs(area - wins) < 1e-12
    assert abs(M.auc(table, ["model"], "t", F.col("y") == 1).first()["auc"] - (1 - area)) < 1e-12


def test_bracketed_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 1000, 20001):
        data = np.round(rng.normal(size=n), 3)
        table = spark.createDataFrame([(float(v), None if i % 5 else float(v)) for i, v in enumerate(data)], "a double, b double")
        points = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
        got = {(r["feature"], r["q"]): r["value"] for r in P.exact_quantiles(table, ["a", "b"], points).collect()}
        for q in points:
            assert abs(got[("a", q)] - np.quantile(data, q)) < 1e-12
            assert abs(got[("b", q)] - np.quantile(data[::5], q)) < 1e-12


def test_split_is_a_partition_and_order_free(spark, fx):
    table = fx.feats.select("row_id", "label")
    a = S.stratified_split(table, ["label"], "row_id")
    b = S.stratified_split(table.repartition(5, "row_id"), ["label"], "row_id")
    assert a.count() == table.count() and a.select("row_id").distinct().count() == table.count()
    assert a.exceptAll(b.select(a.columns)).count() == 0
    assert all(r["disjoint"] for r in S.split_overlaps(a, "row_id").collect())


def test_folds_shrink_to_the_smallest_class(spark):
    table = spark.range(23).select("id", F.when(F.col("id") < 3, 1).otherwise(0).alias("label"))
    sizes = {(r["label"], r["fold"]): r["count"] for r in S.stratified_folds(table, ["label"], "id", 5).groupBy("label", "fold").count().collect()}
    assert {f for _, f in sizes} == {0, 1, 2}
    assert [sizes[(1, f)] for f in range(3)] == [1, 1, 1] and sorted(sizes[(0, f)] for f in range(3)) == [6, 7, 7]


def test_sweep_recall_never_rises(fx):
    sweep = M.threshold_sweep(fx.preds, ["model"], "score", F.col("y_true") >= 2, [i / 20 for i in range(1, 20)])
    for model in ("m1", "m2"):
        recalls = [r["recall"] for r in sweep.filter(F.col("model") == model).orderBy("threshold").collect()]
        assert recalls == sorted(recalls, reverse=True)


def test_wide_split_does_not_shuffle_rows(fx, spark):
    """Only the cut points are computed from shuffles; the table is scanned, joined by broadcast and labelled."""
    table = fx.table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    plan = S.stratified_split(table, ["o_orderstatus"], "o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_first_per_class_limits_groups_before_the_shuffle(fx):
    out = S.first_per_class(fx.feats.select("row_id", "label"), "label", [F.col("row_id")], 3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_quantiles_of_any_doubles_without_sketches(spark, monkeypatch):
    def refused(*args):
        raise AssertionError("a sketch takes every cell one by one")

    monkeypatch.setattr(P.F, "percentile_approx", refused)
    data = [-1e300, -2.5, -0.0, 0.0, 5e-324, 1.0, 1.0 + 2 ** -52, 7.0, 1e9 + 0.1, 1e9 + 0.2, 1e300]
    table = spark.createDataFrame([(v, None, v) for v in data] + [(float("nan"), None, 3.0), (float("inf"), None, 4.0)], "a double, none double, c double")
    points = [0.0, 0.1, 0.3, 0.35, 0.5, 0.6, 0.8, 0.93, 1.0]
    got = {(r["feature"], r["q"]): r["value"] for r in P.exact_quantiles(table, ["a", "none", "c"], points).collect()}
    for q in points:
        low = sorted(data)[int(np.floor(q * 10))]
        high = sorted(data)[int(np.ceil(q * 10))]
        assert got[("a", q)] == low + (high - low) * (q * 10 - np.floor(q * 10))
        assert got[("none", q)] is None and got[("c", q)] is not None
    assert {r["median"] for r in P.medians(table, ["none"]).collect()} == {0.0}
