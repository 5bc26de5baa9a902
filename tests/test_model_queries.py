"""Registered model queries that really fit, on the smallest tables and within a bound of time."""

import time

import pytest

from conftest import SMALL
from gradewell.plans.registry import load_catalog

BOUND = 150


@pytest.mark.parametrize(("name", "rows"), [("m05_forests", 3), ("m06_boosted_trees_grades", 1), ("m17_native_importance", 7), ("m17_permutation_importance", 7)])
def test_query_fits_in_time(spark, name, rows):
    start = time.time()
    found = load_catalog().queries[name](spark, SMALL).collect()
    assert len(found) == rows and time.time() - start < BOUND


def test_search_runs_all_trials(spark):
    start = time.time()
    found = load_catalog().queries["m11_parameter_search"](spark, SMALL).collect()
    assert [r["trial"] for r in found] == list(range(50)) and {r["state"] for r in found} <= {"COMPLETE", "PRUNED"}
    assert min(r["value"] for r in found if r["state"] == "COMPLETE") > 0 and time.time() - start < 2 * BOUND
