"""Sizes of the registered model queries: those of the reference."""

import pytest

from gradewell.plans import modelling as P


class Stop(Exception):
    pass


@pytest.mark.parametrize("plan", [P.pipeline_grid, P.cross_validation, P.parameter_search, P.stacking])
def test_five_folds(fx, plan, monkeypatch):
    def folds(table, strata, key, n):
        raise Stop(n)

    monkeypatch.setattr(P.S, "stratified_folds", folds)
    with pytest.raises(Stop) as stopped:
        plan(fx)
    assert stopped.value.args == (5,)


@pytest.mark.parametrize(("plan", "least"), [(P.boosted_trees, {"maxIter": 220}),
                                             (P.native_importance, {"numTrees": 180}), (P.permutation_importance, {"numTrees": 120}), (P.logistic_regression, {"maxIter": 5000})])
def test_reference_sizes(fx, plan, least, monkeypatch):
    def fit(*args, **params):
        raise Stop(params)

    monkeypatch.setattr(P.T, "fit", fit)
    with pytest.raises(Stop) as stopped:
        plan(fx)
    assert all(stopped.value.args[0][k] >= v for k, v in least.items())


def test_booster_sizes(fx, monkeypatch):
    def grow(rows, **params):
        raise Stop(params)

    monkeypatch.setattr(P.R, "prepare", lambda *a, **k: None)
    monkeypatch.setattr(P.B, "grow_booster", grow)
    with pytest.raises(Stop) as stopped:
        P.boosted_trees_grades(fx)
    assert stopped.value.args[0]["rounds"] == 220 and stopped.value.args[0]["depth"] == 5


def test_forest_sizes(fx, monkeypatch):
    asked = []

    def grow(rows, kind, **params):
        asked.append((kind, params["n_trees"], params["max_depth"]))
        if len(asked) == 3:
            raise Stop
        return None

    monkeypatch.setattr(P.R, "prepare", lambda *a: None)
    monkeypatch.setattr(P.R, "grow_forest", grow)
    monkeypatch.setattr(P.T, "predictions", lambda *a: fx.preds)
    with pytest.raises(Stop):
        P.forests(fx)
    assert asked == [("random_forest", 240, None), ("extra_trees", 240, None), ("balanced_forest", 220, None)]


def test_trials():
    drawn = P.T.random_candidates(P.TRIAL_RANGES, P.TRIALS)
    assert len(drawn) == 50 and min(c["numTrees"] for c in drawn) >= 4


@pytest.mark.parametrize("plan", [P.logistic_regression, P.support_vectors])
def test_models_of_a_query_share_split_and_preparation(fx, plan, monkeypatch):
    """Before, each of the two models split the table and counted its quantiles anew."""
    calls, parts, made = [], P.split(fx), P.prep.fit_preparation(fx.feats_once, P.INPUTS)
    monkeypatch.setattr(P, "split", lambda fx: calls.append("split") or parts)
    for module in (P.prep, P.T):
        monkeypatch.setattr(module, "fit_preparation", lambda *a: calls.append("preparation") or made)
    fit, few = P.T.fit, {"maxIter": 2, "landmarks": 8}
    monkeypatch.setattr(P.T, "fit", lambda *a, **k: fit(*a, **{n: few.get(n, v) for n, v in k.items()}))
    assert plan(fx).count() == 2 and sorted(calls) == ["preparation", "split"]


def test_parts_of_a_table_are_stored_with_it(fx):
    """Fitting reads a part many times; its rows must not be hashed and placed at every pass."""
    for part in (*P.split(fx), P.folded(fx)):
        assert "md5" not in part._jdf.queryExecution().toString()
