"""Parameter grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.decisions import PARAM_NAMES, ScoreParams, score_grade


def grid_combinations(grid: Mapping[str, Sequence[float]]) -> list[dict[str, float]]:
    """All combinations, numbered in the order of the lists."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def score_grid(df: DataFrame, findings: dict[str, Column], base: ScoreParams, grid: Mapping[str, Sequence[float]]) -> DataFrame:
    """Grade of every row under every parameter combination: columns of ``df``, ``combo``, ``grade``.

    The combinations are a literal array, so the rows are expanded without a join.
    """
    rows = []
    for number, changed in enumerate(grid_combinations(grid)):
        values = {n: changed.get(n, getattr(base, n)) for n in PARAM_NAMES}
        rows.append(F.struct(F.lit(number).alias("combo"), *[F.lit(float(values[n])).alias(n) for n in PARAM_NAMES]))
    named = {n: F.col(f"_{n}") for n in findings}
    prepared = df.select("*", *[c.alias(f"_{n}") for n, c in findings.items()])
    expanded = prepared.select("*", F.explode(F.array(*rows)).alias("_p"))
    params = {n: F.col("_p")[n] for n in PARAM_NAMES}
    return expanded.select(*df.columns, F.col("_p")["combo"].alias("combo"), score_grade(named, params).alias("grade"))
