"""Forests against a brute-force tree, and their independence from how the work is cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.models import forests as R
from gradewell.models import training as T

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    label = np.concatenate([rng.integers(0, 3, 150), np.zeros(50, int)])
    rows = [(i, int(y), float(y + rng.normal(0, 1)), float(rng.integers(0, 6)), None if i % 9 == 0 else float("nan") if i % 9 == 1 else float(rng.normal()))
            for i, y in enumerate(label)]
    return spark.createDataFrame(rows, "row_id int, label int, a double, b double, c double").repartition(3)


@pytest.fixture(scope="module")
def training(table):
    return R.prepare(table, FEATURES, ["row_id"], max_bins=16)


def brute_force(bins, labels, classes, min_leaf):
    """Class counts and cuts of the greedy tree, in depth-first order."""
    totals = [int((labels == c).sum()) for c in range(classes)]
    best = None
    for f in range(bins.shape[1]):
        for cut in sorted(set(bins[:, f].tolist())):
            left = bins[:, f] <= cut
            if min(left.sum(), (~left).sum()) < min_leaf:
                continue
            score = sum(sum(int((labels[s] == c).sum()) ** 2 for c in range(classes)) / s.sum() for s in (left, ~left))
            if best is None or score > best[0] + 1e-12:
                best = (score, f, cut, left)
    if len(labels) < 2 * min_leaf or sum(t > 0 for t in totals) < 2 or best is None:
        return [(None, None, totals)]
    _, f, cut, left = best
    return [(f, cut, totals), *brute_force(bins[left], labels[left], classes, min_leaf), *brute_force(bins[~left], labels[~left], classes, min_leaf)]


def tree_of(nodes, root):
    found = {r["node"]: r for r in nodes}

    def walk(node):
        r = found[node]
        if r["feature"] == R.LEAF:
            return [(None, None, list(r["counts"]))]
        return [(r["feature"], r["cut"], list(r["counts"])), *walk(r["left"]), *walk(r["right"])]

    return walk(root)


def test_one_tree_equals_brute_force(training):
    rows = training.rows.collect()
    bins, labels = np.array([list(r["bins"]) for r in rows]), np.array([r["label"] for r in rows])
    growth = R.Growth(1, 3, 3, (0, 1, 2), 3, (1.0, 1.0, 1.0), min_leaf=2, max_bins=16)
    want = brute_force(bins, labels, 3, 2)
    for local_rows in (1, 40, 1000):
        nodes = R.Forest(growth, training.rows, local_rows, 200).grown().collect()
        assert tree_of(nodes, int(growth.root(0).view(np.int64))) == want


@pytest.mark.parametrize("kind", R.KINDS)
def test_trees_do_not_depend_on_the_cut_of_the_work(training, kind):
    def nodes(local_rows):
        model = R.grow_forest(training, kind, n_trees=4, strategy=1, local_rows=local_rows)
        return sorted(map(repr, model.nodes.select("tree", "node", "feature", "cut", "counts").collect()))

    assert nodes(10) == nodes(60) == nodes(10_000)


def test_upper_nodes_do_not_need_the_arrow_setting(spark, training):
    """Before, a node table as pandas rows failed in a session without Arrow conversion, once any node was split by counts."""
    def nodes(local_rows):
        model = R.grow_forest(training, "random_forest", n_trees=2, local_rows=local_rows)
        return sorted(map(repr, model.nodes.collect()))

    name = "spark.sql.execution.arrow.pyspark.enabled"
    kept = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        assert nodes(20) == nodes(10_000)
    finally:
        spark.conf.set(name, kept)


def test_kinds_differ_and_depth_is_kept(training):
    made = {k: sorted(map(repr, R.grow_forest(training, k, n_trees=2).nodes.select("node", "feature", "cut").collect())) for k in R.KINDS}
    assert len(set(map(tuple, made.values()))) == 3
    assert R.grow_forest(training, "random_forest", n_trees=3, max_depth=2).nodes.groupBy("tree").count().agg(F.max("count")).first()[0] <= 7


def test_draws(training):
    """Balanced trees draw as many rows of every class as the rarest has, within sampling error; draws are fixed by the seed."""
    rows = np.arange(200_000, dtype=np.int64) * 7919
    labels = np.repeat([0, 1, 2], [150_000, 40_000, 10_000])
    growth = R.Growth(2, 3, 1, (0,), 1, (1.0,) * 3, rates=(1 / 15, 1 / 4, 1.0))
    for tree in (0, 1):
        counts = np.bincount(labels, growth.draws(tree, rows, labels))
        assert (abs(counts - 10_000) < 5 * np.sqrt(10_000)).all()
    one = R.Growth(1, 1, 1, (0,), 1, (1.0,), rates=(1.0,)).draws(0, rows, np.zeros(200_000, int))
    share = np.bincount(one)[:4] / 200_000
    assert abs(share - np.exp(-1) / np.array([1, 1, 2, 6])).max() < 0.005
    assert (growth.draws(0, rows, labels) == growth.draws(0, rows, labels)).all() and (growth.draws(0, rows, labels) != growth.draws(1, rows, labels)).any()


def test_predictions_passes_and_persistence(spark, table, training, tmp_path):
    model = R.grow_forest(training, "random_forest", n_trees=7)
    scored = model.predictions(table, ["row_id"], "label", [0, 1, 2, 3]).orderBy("row_id").collect()
    assert np.mean([r["y_true"] == r["y_pred"] for r in scored]) > 0.8 and all(len(r["prob"]) == 4 and abs(sum(r["prob"]) - 1) < 1e-9 for r in scored)
    binned = model.bins.apply(table, ["row_id"])
    whole, cut = (model.votes(binned, ["row_id"], nodes_per_pass=n).orderBy("row_id").collect() for n in (10 ** 6, 1))
    assert np.allclose([r["prob"] for r in whole], [r["prob"] for r in cut])
    T.save_model(model, str(tmp_path / "f"), FEATURES, threshold=0.4)
    loaded, metadata = T.load_model(spark, str(tmp_path / "f"))
    assert metadata["threshold"] == 0.4 and loaded.predictions(table, ["row_id"], "label", [0, 1, 2, 3]).orderBy("row_id").collect() == scored
    importance = {r["feature"]: r["score"] for r in model.importance().collect()}
    assert abs(sum(importance.values()) - 1) < 1e-9 and set(importance) == set(FEATURES)


def test_versions_use_their_columns(table, training):
    model = R.grow_forest(training, "random_forest", n_trees=5, features=["c", "a"])
    assert {r["feature"] for r in model.importance().collect()} == {"a", "c"}
    changed = table.withColumn("b", F.lit(3.0))
    assert model.predictions(table, ["row_id"], None, [0, 1, 2]).orderBy("row_id").collect() == model.predictions(changed, ["row_id"], None, [0, 1, 2]).orderBy("row_id").collect()


def test_odd_tables(spark, table):
    one = R.fit_forest(table.filter("label = 1"), FEATURES, "balanced_forest", ["row_id"], n_trees=2)
    assert {r["y_pred"] for r in one.predictions(table, ["row_id"], None, [0, 1]).collect()} == {1}
    with pytest.raises(ValueError):
        R.fit_forest(table.withColumn("label", F.lit(None).cast("int")), FEATURES, "random_forest", ["row_id"])
    assert one.predictions(table.limit(0), ["row_id"], "label", [0, 1]).count() == 0


def test_scoring_holds_no_forest_in_driver_or_broadcast(spark, table, training, monkeypatch):
    """A chain of passes with broadcast trees took memory for all trees in every task."""
    model = R.grow_forest(training, "random_forest", n_trees=6)
    binned = model.bins.apply(table, ["row_id"])

    def refused(*args, **kwargs):
        raise AssertionError("nodes on their way through the driver")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    monkeypatch.setattr(type(model.nodes), "toArrow", refused)
    votes = model.votes(binned, ["row_id"], nodes_per_pass=1)
    assert votes.count() == table.count()
    assert votes._jdf.queryExecution().toString().count("mapInArrow") <= 1 and votes.columns == ["row_id", "prob"]


def test_counts_of_a_level_are_bounded(training, monkeypatch):
    """Nodes of many trees are counted in parts, with the same trees."""
    def nodes():
        model = R.grow_forest(training, "random_forest", n_trees=2, local_rows=100)
        return sorted(map(repr, model.nodes.select("tree", "node", "feature", "cut", "counts").collect()))

    parts, level, whole = [], R.Forest.level, nodes()
    monkeypatch.setattr(R, "CELLS_PER_PASS", 1)
    monkeypatch.setattr(R.Forest, "level", lambda self, frontier: parts.append(sum(map(len, frontier.values()))) or level(self, frontier))
    assert nodes() == whole and len(parts) > 2 and set(parts) == {1}


def test_further_features_are_sought_in_waiting_nodes_only():
    """Before, every further feature of a node without a cut read and cut down the rows of all nodes again."""
    rng = np.random.default_rng(2)
    bins, labels, node = rng.integers(0, 3, (400, 6)), rng.integers(0, 2, 400), np.sort(rng.integers(0, 40, 400))
    bins[:, :4] = 0  # most features have no cut
    totals = np.bincount(node * 2 + labels, minlength=80).reshape(-1, 2)
    asked = []

    def entries(f):
        asked.append(f)
        return node, bins[:, f], labels, np.ones(400, np.int64)

    growth = R.Growth(1, 2, 6, tuple(range(6)), 1, (1.0, 1.0), min_leaf=1, max_bins=3)
    feature, _, _, left = growth.splits(R.mixed(np.arange(40, dtype=np.uint64)), entries, totals)
    assert set(feature.tolist()) <= {4, 5, R.LEAF} and (left[feature != R.LEAF].sum(axis=1) > 0).all()
    assert max(asked.count(f) for f in range(6)) <= 2


def test_leaves_hold_no_hashes_of_children(training):
    """Before, more than half of the nodes carried two hashes, which no compression shortens, for nodes that do not exist."""
    for local_rows in (20, 10_000):
        nodes = R.grow_forest(training, "random_forest", n_trees=2, local_rows=local_rows).nodes
        assert nodes.filter("feature < 0").count() > 0 and nodes.filter("(feature < 0) <> (left = 0) or (feature < 0) <> (right = 0)").count() == 0


def test_search_over_forests_with_upper_nodes_does_not_need_the_arrow_setting(spark, table):
    from gradewell.operators import splits as S
    from gradewell.session import materialize

    name = "spark.sql.execution.arrow.pyspark.enabled"
    kept = spark.conf.get(name)
    folds = materialize(S.stratified_folds(table, ["label"], "row_id", 2))
    spark.conf.set(name, "false")
    try:
        logs = [T.search(folds, FEATURES, "random_forest", [{"numTrees": 2, "local_rows": n}], "row_id", labels=[0, 1, 2]).first() for n in (20, 10_000)]
    finally:
        spark.conf.set(name, kept)
    assert logs[0]["state"] == "COMPLETE" and logs[0]["value"] == logs[1]["value"]
