"""The softmax booster against the same rounds without Spark, and its loss."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.models import boosting as B
from gradewell.models import forests as R

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    label = rng.integers(0, 4, 300)
    rows = [(i, int(y), float(y + rng.normal(0, .7)), float((y == 2) + rng.normal(0, .5)), None if i % 7 == 0 else float(rng.normal())) for i, y in enumerate(label)]
    return spark.createDataFrame(rows, "row_id int, label int, a double, b double, c double")


@pytest.fixture(scope="module")
def training(table):
    return R.prepare(table, FEATURES, ["row_id"], max_bins=32)


def naive_round(s, bins, labels, rows, weights, margins, round_):
    """One round, node by node and bin by bin."""
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    y = np.eye(s.classes)[labels]
    used = R.uniform(R.mixed(rows.view(np.uint64) ^ R.mixed(R.mixed(s.seed) + np.uint64(round_))[0])) < s.share
    g, h = (p - y) * weights[:, None] * used[:, None], np.maximum(p * (1 - p), 1e-6) * weights[:, None] * used[:, None]
    out = margins.copy()
    allowed = s.features(round_)

    def grow(c, at, depth):
        if depth == s.depth:
            out[at, c] -= s.rate * g[at, c].sum() / (h[at, c].sum() + s.ridge)
            return
        best = (1e-9, None, None)
        whole = g[at, c].sum() ** 2 / (h[at, c].sum() + s.ridge)
        for f in np.flatnonzero(allowed[c]):
            for cut in range(s.n_bins - 1):
                left = at[bins[at, f] <= cut]
                right = at[bins[at, f] > cut]
                if h[left, c].sum() < s.least_weight or h[right, c].sum() < s.least_weight:
                    continue
                gain = sum(g[x, c].sum() ** 2 / (h[x, c].sum() + s.ridge) for x in (left, right)) - whole
                if gain > best[0] + 1e-7:
                    best = (gain, f, cut)
        if best[1] is None:
            grow(c, at, depth + 1)
        else:
            grow(c, at[bins[at, best[1]] <= best[2]], depth + 1)
            grow(c, at[bins[at, best[1]] > best[2]], depth + 1)

    for c in range(s.classes):
        grow(c, np.arange(len(labels)), 0)
    return out


def test_equals_a_plain_version(table, training):
    model = B.grow_booster(training, rounds=3, depth=3, rate=.3)
    rows = training.rows.collect()
    bins, labels, ids = np.array([list(r["bins"]) for r in rows]), np.array([r["label"] for r in rows]), np.array([r["row"] for r in rows])
    weights = (len(rows) / (4 * np.bincount(labels)))[labels]
    margins = np.zeros((len(rows), 4))
    for r in range(3):
        margins = naive_round(model.sizes, bins, labels, ids, weights, margins, r)
    want = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
    got = {r["row"]: r["prob"] for r in model.votes(training.rows, ["row"]).collect()}
    assert np.allclose([got[i] for i in ids.tolist()], want, atol=1e-5)


def test_tasks_do_not_matter(training):
    one, three = (B.grow_booster(training, rounds=3, depth=2, rows_per_task=n) for n in (1000, 100))
    assert sorted(map(repr, one.rounds.collect())) == sorted(map(repr, three.rounds.collect()))


def test_loss_falls(training):
    losses = B.grow_booster(training, rounds=60, depth=3).losses()
    assert all(b < a for a, b in zip(losses, losses[1:])) and losses[-1] < losses[0] * .6


def test_predictions(table, training):
    model = B.grow_booster(training, rounds=25, depth=4, rate=.2)
    scored = model.predictions(table, ["row_id"], "label", [0, 1, 2, 3, 4]).collect()
    assert np.mean([r["y_true"] == r["y_pred"] for r in scored]) > .8 and all(len(r["prob"]) == 5 for r in scored)
    assert model.predictions(table.limit(0), ["row_id"], None, [0, 1, 2, 3]).count() == 0


def test_levels_are_jobs_of_any_cluster(spark, table, training, monkeypatch):
    """An exchange in a barrier stage waits a second; a table of several tasks needed six a round. Checkpoints change nothing."""
    monkeypatch.setattr(B, "ROUNDS_KEPT", 2)
    rows = []
    plan = B.store
    monkeypatch.setattr(B, "store", lambda df: rows.append(df._jdf.queryExecution().toString()) or plan(df))
    several = B.grow_booster(training, rounds=5, depth=3, rows_per_task=40)
    assert not any("MapInArrow" in r for r in rows)
    one = B.grow_booster(training, rounds=5, depth=3)
    assert sorted(map(repr, one.rounds.collect())) == sorted(map(repr, several.rounds.collect()))
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def naive_logistic(s, bins, y, rows, weights, round_, margins):
    """Margins after one more logistic round, node by node and bin by bin."""
    p = 1 / (1 + np.exp(-margins))
    used = R.uniform(R.mixed(rows.view(np.uint64) ^ R.mixed(R.mixed(s.seed) + np.uint64(round_))[0])) < s.share
    g, h = (p - y) * weights * used, np.maximum(p * (1 - p), 1e-6) * weights * used
    out, allowed = margins.copy(), np.flatnonzero(s.features(round_)[0])

    def worth(at):
        return g[at].sum() ** 2 / (h[at].sum() + s.ridge)

    def grow(at, depth):
        sides = [(bins[at, f] <= cut, f) for f in allowed for cut in range(s.n_bins - 1)] if depth < s.depth else []
        best = (1e-9, None)
        for left, _ in sides:
            if min(h[at[left]].sum(), h[at[~left]].sum()) >= s.least_weight:
                gain = worth(at[left]) + worth(at[~left]) - worth(at)
                if gain > best[0] + 1e-7:
                    best = (gain, left)
        if best[1] is None:
            out[at] -= s.rate * g[at].sum() / (h[at].sum() + s.ridge)
        else:
            grow(at[best[1]], depth + 1)
            grow(at[~best[1]], depth + 1)

    grow(np.arange(len(y)), 0)
    return out


@pytest.fixture(scope="module")
def binary(table):
    return R.prepare(table.withColumn("label", (F.col("label") >= 2).cast("int")), FEATURES, ["row_id"], max_bins=32)


def test_logistic_equals_a_plain_version(binary):
    """Two classes took Spark ML's row-by-row trees; now one tree a round from the same histograms as the softmax booster."""
    model = B.grow_booster(binary, logistic=True, rounds=4, depth=3, rate=.3)
    assert model.sizes.trees == 1
    rows = binary.rows.collect()
    bins, labels, ids = np.array([list(r["bins"]) for r in rows]), np.array([r["label"] for r in rows]), np.array([r["row"] for r in rows])
    weights, margins = (len(rows) / (2 * np.bincount(labels)))[labels], np.zeros(len(rows))
    for r in range(4):
        margins = naive_logistic(model.sizes, bins, labels, ids, weights, r, margins)
    got = {r["row"]: r["prob"] for r in model.votes(binary.rows, ["row"]).collect()}
    assert np.allclose([got[i][1] for i in ids.tolist()], 1 / (1 + np.exp(-margins)), atol=1e-5)
    assert all(abs(sum(p) - 1) < 1e-12 for p in got.values())
    several = B.grow_booster(binary, logistic=True, rounds=4, depth=3, rate=.3, rows_per_task=60)
    assert sorted(map(repr, several.rounds.collect())) == sorted(map(repr, model.rounds.collect()))


def test_walk_of_deep_trees(monkeypatch):
    rng = np.random.default_rng(5)
    bins, feature, cut = rng.integers(0, 32, (3, 500)).astype(np.uint8), rng.integers(-1, 3, 1 << 9), rng.integers(0, 32, 1 << 9)
    narrow = [B.Boosting.walk(bins, feature, cut, d).tolist() for d in range(10)]
    monkeypatch.setattr(B, "NARROW", 0)
    assert narrow == [B.Boosting.walk(bins, feature, cut, d).tolist() for d in range(10)]


def test_boosted_trees_are_fitted_saved_and_loaded(spark, table, tmp_path):
    """Before, ``fit`` gave Spark ML's trees, grown row by row."""
    from gradewell.models import training as T

    rows = table.withColumn("label", (F.col("label") >= 2).cast("int"))
    model = T.fit(rows, FEATURES, "boosted_trees", key="row_id", maxIter=30, maxDepth=3, stepSize=.2, subsamplingRate=.9, featureSubsetStrategy="0.85")
    s = model.sizes
    assert (s.logistic, s.rounds, s.depth, s.rate, s.share, s.feature_share, s.classes) == (True, 30, 3, .2, .9, .85, 2)
    scored = T.predictions(model, rows, ["row_id"], labels=[0, 1]).collect()
    assert np.mean([r["y_true"] == r["y_pred"] for r in scored]) > .9
    T.save_model(model, str(tmp_path), FEATURES)
    loaded, _ = T.load_model(spark, str(tmp_path))
    assert sorted(map(repr, T.predictions(loaded, rows, ["row_id"], labels=[0, 1]).collect())) == sorted(map(repr, scored))
    assert T.permutation_importance(model, rows, FEATURES, "row_id", repeats=1, labels=[0, 1]).count() == 3
    with pytest.raises(ValueError):
        T.native_importance(model, FEATURES, spark)
    assert T.fit(table, FEATURES, "boosted_trees", key="row_id", maxIter=2).sizes.trees == 4


def blocks_of(training, s):
    rows = training.rows.collect()
    bins = np.array([list(r["bins"]) for r in rows], np.uint8)
    return [B.Block(np.array([r["row"] for r in rows]), np.array([r["label"] for r in rows], np.uint8), np.ascontiguousarray(bins.T), np.zeros((len(rows), s.trees), order="F"))]


def test_only_the_lighter_child_of_a_node_is_summed(training):
    """Before, it was the left one, however many rows it has."""
    s = B.Boosting(4, 3, 32, rounds=3, depth=4)
    state, weights, heavier = blocks_of(training, s), np.ones(4), []

    def ask(tree, round_, level, feature, cut, asked):
        if level == 0 and tree is not None:
            state[:] = [s.advanced(b, tree) for b in state]
        drawn = s.draw(state[0], weights, round_)
        sums = s.histograms(drawn, round_, level, feature, cut, asked)
        if level:
            sides = asked[:, 1 << level:2 << level].reshape(4, -1, 2)
            assert (sides.sum(axis=2) == 1).all()
            other = s.histograms(drawn, round_, level, feature, cut, ~asked)
            f = s.features(round_).argmax(axis=1)
            mine, theirs = (x[:-1].reshape(4, -1, 3, 32, 2)[np.arange(4), :, f, :, 1].sum(axis=2) for x in (sums, other))
            assert (mine <= theirs).all()
            heavier.append((theirs > mine).mean())
        return sums

    rounds = [B.round_batch(r) for r in s.train(ask)]
    assert max(heavier) > .9
    model = B.grow_booster(B.Training(training.bins, training.rows, {c: 1 for c in range(4)}), rounds=3, depth=4)
    assert [(r["feature"], r["cut"], r["value"]) for r in model.rounds.orderBy("round").collect()] == [(r["feature"], r["cut"], r["value"]) for r in rounds]


def test_gradients_of_a_round_are_packed_without_loss(training):
    """Before, every gradient and Hessian, a whole number below 2 ** 31, took eight bytes and was moved in them at every level."""
    s = B.Boosting(4, 3, 32)
    (block,) = blocks_of(training, s)
    small, large = s.draw(block, np.ones(4), 0), s.draw(block, np.full(4, 5.0), 0)
    assert (small.g.itemsize, large.g.itemsize) == (4, 8) and small.bins.shape[1] == small.g.shape[1] == small.h.shape[1]
    assert np.abs(large.g - 5.0 * small.g).max() < 5 and np.abs(large.g).max() > 2 ** 31


def test_margins_need_not_be_written_every_round(training, monkeypatch):
    made = []
    for merged in (1, 3, 100):
        monkeypatch.setattr(B, "ROUNDS_MERGED", merged)
        made.append(sorted(map(repr, B.grow_booster(training, rounds=8, depth=3, rows_per_task=100).rounds.collect())))
    assert made[0] == made[1] == made[2]
