"""Decision rules as ordered conditions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.functions.labels import lookup
from gradewell.functions.numeric import clip


def rule_grade(ma_count: Column, exudate_count: Column, exudate_quadrants: Column, vessel_density: Column,
               glcm_contrast: Column) -> tuple[Column, Column]:
    """(grade, rule) from finding counts; the first matching rule decides."""
    rules = [
        ((vessel_density > 0.12) & (glcm_contrast > 500.0), 4,
         "vessel density and GLCM contrast exceeded the proliferative override"),
        ((ma_count == 0) & (exudate_count == 0), 0, "no microaneurysms or exudates detected"),
        ((ma_count > 15) | (exudate_quadrants >= 2), 3,
         "more than 15 microaneurysms or exudates across at least two quadrants"),
        (ma_count.between(1, 5) & (exudate_count == 0), 1, "1 to 5 microaneurysms and no exudates detected"),
        (ma_count.between(6, 15) | ((exudate_count > 0) & (exudate_quadrants == 1)), 2,
         "6 to 15 microaneurysms or exudates localized to one quadrant"),
    ]
    grade, text = F.lit(1), F.lit("minimal non-zero lesion evidence detected")
    for condition, value, reason in reversed(rules):
        grade, text = F.when(condition, value).otherwise(grade), F.when(condition, reason).otherwise(text)
    return grade, text


@dataclass(frozen=True)
class ScoreParams:
    """Weights and thresholds of the weighted-score grade (fixed defaults)."""

    ma_weight: float = 1.0
    exudate_weight: float = 1.4
    quadrant_weight: float = 5.0
    area_weight: float = 14.0
    vessel_weight: float = 0.2
    glcm_weight: float = 0.02
    grade1: float = 1.0
    grade2: float = 8.0
    grade3: float = 18.0
    grade4: float = 42.0
    grade4_vessel_density: float = 0.12
    grade4_glcm_contrast: float = 500.0


PARAM_NAMES = list(ScoreParams.__dataclass_fields__)


def weighted_score(findings: dict[str, Column], p: dict[str, Column]) -> Column:
    return (
        findings["ma_count"] * p["ma_weight"] + findings["exudate_count"] * p["exudate_weight"]
        + findings["exudate_quadrants"] * p["quadrant_weight"] + findings["pathology_area_index"] * p["area_weight"]
        + findings["vessel_density"] * 100.0 * p["vessel_weight"] + findings["glcm_contrast"] * p["glcm_weight"]
    )


def score_grade(findings: dict[str, Column], p: dict[str, Column]) -> Column:
    """Grade of the weighted score; parameters may be literals or columns of a parameter table."""
    score = weighted_score(findings, p)
    lesions = findings["ma_count"] + findings["exudate_count"]
    extreme = ((score >= p["grade4"]) & (findings["vessel_density"] >= p["grade4_vessel_density"])
               & (findings["glcm_contrast"] >= p["grade4_glcm_contrast"]))
    return (
        F.when(extreme, 4).when((lesions == 0) & (score < p["grade1"]), 0)
        .when(score >= p["grade3"], 3).when(score >= p["grade2"], 2)
        .when((score >= p["grade1"]) | (lesions > 0), 1).otherwise(0)
    )


def literal_params(params: ScoreParams) -> dict[str, Column]:
    return {n: F.lit(getattr(params, n)) for n in PARAM_NAMES}


def reconcile(positive: Column, grade: Column, min_grade: int = K.POSITIVE_MIN_GRADE) -> dict[str, Column]:
    """Binary decision against the grade: status, final flag, result and label."""
    by_grade = grade >= min_grade
    differs = positive != by_grade
    return {
        "status": F.when(differs & by_grade, "severity_escalation").when(differs, "screening_severity_disagreement")
        .otherwise("aligned"),
        "positive": differs | positive,
        "result": F.when(differs, "referable_review").when(positive, "referable").otherwise("non_referable"),
        "label": F.when(differs, "Referable / Needs ophthalmologist review").when(positive, "Referable DR")
        .otherwise("Non-referable DR"),
    }


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.80, "high").when(confidence >= K.LOW_CONFIDENCE, "medium").otherwise("low")


def confidence_label(confidence: Column) -> Column:
    """Tiers 0.75 / 0.45; a missing confidence is medium."""
    return (F.when(confidence.isNull(), "Medium Confidence").when(confidence >= 0.75, "High Confidence")
            .when(confidence >= 0.45, "Medium Confidence").otherwise("Low Confidence"))


def screening_result(quality_ok: Column, available: Column, aligned: Column, positive: Column,
                     probability: Column) -> dict[str, Column]:
    """Result fields. Gates in order: quality, availability, disagreement, confidence, decision.

    Rows that were not assessed carry NULL probabilities, never 0.
    """
    p = clip(probability, 0.0, 1.0)
    assessed = quality_ok & available
    confidence = F.greatest(p, 1.0 - p)

    def chain(low_quality: str, unavailable: str, review: str, unsure: str, yes: str, no: str) -> Column:
        return (F.when(~quality_ok, low_quality).when(~available, unavailable).when(~aligned, review)
                .when(confidence < K.LOW_CONFIDENCE, unsure).when(positive, yes).otherwise(no))

    return {
        "result": chain("uncertain", "uncertain", "referable_review", "uncertain", "referable", "non_referable"),
        "label": chain("Uncertain screening result", "Analysis models unavailable",
                       "Referable / Needs ophthalmologist review", "Uncertain screening result", "Referable DR",
                       "Non-referable DR"),
        "confidence": F.when(assessed, confidence),
        "confidence_level": F.when(assessed, confidence_tier(confidence)).otherwise("low"),
        "positive_probability": F.when(assessed, p),
        "negative_probability": F.when(assessed, 1.0 - p),
    }


def grade_score(grade: Column, area_index: Column) -> Column:
    """Base score per grade plus at most 4 for the affected area; grade 0 scores 0."""
    base = F.coalesce(F.try_element_at(lookup(K.GRADE_SCORES), grade), F.lit(0.0))
    return F.when(grade == 0, 0.0).otherwise(F.bround(clip(base + F.least(area_index * 2.0, F.lit(4.0)), 0.0, 99.0), 1))


def positive_percentage(grade: Column, prob: Column, min_grade: int = K.POSITIVE_MIN_GRADE) -> Column:
    """Probability of a positive grade in percent; without probabilities a fallback score by grade."""
    summed = F.aggregate(F.filter(prob, lambda p, i: i >= min_grade), F.lit(0.0), lambda a, p: a + p)
    fallback = F.when(grade >= min_grade, grade_score(grade, F.lit(0.0))).otherwise(0.0)
    return F.when(prob.isNotNull(), F.bround(clip(summed * 100.0, 0.0, 100.0), 1)).otherwise(F.coalesce(fallback, F.lit(0.0)))


def grade_tier(grade: Column, min_grade: int = K.POSITIVE_MIN_GRADE) -> dict[str, Column]:
    """Tier of a grade; a missing grade cannot be staged."""
    return {
        "status": F.when(grade.isNull(), "Unstageable").when(grade >= min_grade, "Referable").otherwise("Non-Referable"),
        "positive": F.coalesce(grade >= min_grade, F.lit(False)),
        "rule": F.when(grade.isNull(), "Quality gate failed")
        .when(grade >= min_grade, "DR grades 2-4 are mapped to referable screening-support review.")
        .otherwise("DR grades 0-1 are mapped to non-referable screening-support review."),
    }


def binary_tier(positive: Column, threshold: Column) -> dict[str, Column]:
    """Tier of a binary decision; the rule names the threshold with two decimals (0.20 when missing)."""
    text = F.format_string("%.2f", F.coalesce(threshold, F.lit(K.DEFAULT_THRESHOLD)))
    side = F.when(positive, "referable").otherwise("non-referable")
    return {
        "status": F.when(positive, "Referable").otherwise("Non-Referable"),
        "positive": positive,
        "rule": F.concat(F.lit("Binary screening model classified the case as "), side,
                         F.lit(" using optimized probability threshold "), text, F.lit(".")),
    }


def findings_list(flags: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """(all findings as label/detected structs, labels of the detected ones)."""
    everything = F.array(*[F.struct(F.lit(label).alias("label"), flag.alias("detected")) for label, flag in flags])
    return everything, F.transform(F.filter(everything, lambda f: f["detected"]), lambda f: f["label"])


def staged_grade(no_finding: Column, positive: Column, severity: Column, late: Column | None = None) -> Column:
    """Gate, then positive, then grade: 0 below one half, 1 below one half, else the severity model.

    ``late`` is the decision of a model that tells the last two grades apart.
    """
    grade = F.when(no_finding < 0.5, 0).when(positive < 0.5, 1).otherwise(severity)
    return grade if late is None else F.when(grade.isin(3, 4), F.when(late == 1, 4).otherwise(3)).otherwise(grade)


def grouped_grade(group: Column, positive_grade: Column, early_grade: Column | None = None) -> Column:
    """Group 0 / 1 / 2: grade 0, then 1 (or the early model's grade), then the positive model's grade."""
    first = F.lit(0)
    second = F.lit(1) if early_grade is None else early_grade
    return F.when(group == 0, first).when(group == 1, second).otherwise(positive_grade)


def pair_corrections(pred: Column, corrections: Sequence[tuple[int, int, Column]]) -> Column:
    """Override predictions in {a, b} by a sub-model (1 means b); later pairs see earlier corrections."""
    for a, b, decision in corrections:
        pred = F.when(pred.isin(a, b), F.when(decision == 1, b).otherwise(a)).otherwise(pred)
    return pred
