"""Expressions over class-probability arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.functions.numeric import bind

ENTROPY_FLOOR = 1e-9


def first_argmax(prob: Column) -> Column:
    """0-based position of the largest value, the first one on ties."""
    return (F.array_position(prob, F.array_max(prob)) - 1).cast("int")


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def prediction_features(prob: Column, positive_from: int = K.POSITIVE_MIN_GRADE) -> dict[str, Column]:
    """Predicted class, largest probability, uncertainty, entropy, margin, expected grade, positive share."""
    ordered = F.sort_array(prob, asc=False)
    entropy = F.aggregate(prob, F.lit(0.0), lambda a, p: a - p * F.log(F.greatest(p, F.lit(ENTROPY_FLOOR))))
    return {
        "predicted_class": first_argmax(prob),
        "max_probability": F.array_max(prob),
        "uncertainty": 1.0 - F.array_max(prob),
        "entropy": entropy,
        "margin": ordered[0] - ordered[1],
        "expected_grade": array_total(F.transform(prob, lambda p, i: p * i)),
        "positive_probability": array_total(F.filter(prob, lambda p, i: i >= positive_from)),
    }


def scaled(values: Column) -> Column:
    """The values divided by their sum; values without a positive sum stay as they are."""
    return bind(array_total(values), lambda whole: F.when(whole > 0, F.transform(
        values, lambda v: v / F.greatest(whole, F.lit(1e-12)))).otherwise(values))


def soft_classes(value: Column, squared: bool = False, labels: Sequence[int] = K.GRADES) -> Column:
    """Softmax of the negative distance (or its square) of a continuous grade to each label."""
    centres = F.array(*[F.lit(float(k)) for k in labels])
    distance = F.transform(centres, lambda c: -F.pow(c - value, 2) if squared else -F.abs(c - value))
    exp = bind(distance, lambda ds: F.transform(ds, lambda d: F.exp(d - F.array_max(ds))))
    return bind(exp, scaled)


def logistic_score(value: Column, centre: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(value - centre)))


def align(prob_by_class: Column, labels: Sequence[int] = K.GRADES) -> Column:
    """A map of class to probability as an array over ``labels``; rows with a positive sum add up to 1."""
    wanted = F.array(*[F.lit(k) for k in labels])
    aligned = bind(prob_by_class, lambda known: F.transform(wanted, lambda k: F.coalesce(F.try_element_at(known, k), F.lit(0.0))))
    return bind(aligned, scaled)


def decide(prob: Column, labels: Sequence[int] = K.GRADES, threshold: float | None = None) -> Column:
    """Binary decision at a threshold on the last class, else the label of the first maximum."""
    names = F.array(*[F.lit(k) for k in labels])
    if threshold is not None and len(labels) == 2:
        return F.when(prob[1] >= threshold, labels[1]).otherwise(labels[0])
    return names[first_argmax(prob)]


def weighted_vote(probs: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """Weighted mean of probability arrays of equal length."""
    weights = list(weights or [1.0] * len(probs))
    whole = sum(weights)

    def plus(weight: float):
        return lambda a, p: a + p * weight

    summed = F.transform(probs[0], lambda p: p * weights[0])
    for prob, weight in zip(probs[1:], weights[1:]):
        summed = F.zip_with(summed, prob, plus(weight))
    return F.transform(summed, lambda s: s / whole)
