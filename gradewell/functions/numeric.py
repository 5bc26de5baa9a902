"""Scalar numeric helpers. Missing is NULL everywhere: NaN and infinities are mapped once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(value: Column) -> Column:
    """Numeric coercion: unparseable text, NaN and infinities become NULL."""
    return finite(value.try_cast("double"))


def finite(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def clip(value: Column, low: float, high: float) -> Column:
    """Value within [low, high]; NULL stays NULL although least and greatest skip it."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def ratio_floor_one(n: Column, d: Column) -> Column:
    """n / max(d, 1); NULL when either side is missing."""
    return F.when(d.isNotNull(), n / F.greatest(d, F.lit(1.0)))


def ratio_abs_floor_one(n: Column, d: Column) -> Column:
    """n / max(|d|, 1), and 0 where the denominator is not a finite number."""
    d = finite(d)
    return F.when(d.isNull(), 0.0).otherwise(n / F.greatest(F.abs(d), F.lit(1.0)))


def ratio_epsilon(a: Column, b: Column, epsilon: float = 1e-6) -> Column:
    """a / (|b| + epsilon)."""
    return a / (F.abs(b) + epsilon)


def harmonic_guarded(a: Column, b: Column, floor: float = 1e-6) -> Column:
    """2ab / max(a + b, floor): the F1 form that never divides by zero."""
    return 2 * a * b / F.greatest(a + b, F.lit(floor))


def zero_div(n: Column, d: Column) -> Column:
    """n / d, and 0 where d is 0."""
    return F.when(d != 0, n.cast("double") / d).otherwise(0.0)


def total(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def mean_of(values: Sequence[Column]) -> Column:
    return total(values) / len(values)


def spread_of(values: Sequence[Column]) -> Column:
    return F.greatest(*values) - F.least(*values)


def param_value(raw: Column, name: Column, integer_names: Sequence[str]) -> Column:
    """A hyper-parameter as text: integers truncated, NaN and empty as NULL, the rest unchanged."""
    text = F.when(F.lower(F.trim(raw)).isin("nan", "none", "null", ""), None).otherwise(raw)
    whole = text.try_cast("double").cast("bigint").cast("string")
    return F.when(name.isin(*integer_names), whole).otherwise(text)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)
