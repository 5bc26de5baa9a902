"""Quality gates over metric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewell.functions.numeric import clip

# Rules of the simple gate: flag and the condition that raises it (fixed values).
SIMPLE_SIZE, SIMPLE_BLUR, SIMPLE_DARK, SIMPLE_BRIGHT, SIMPLE_CONTRAST = 200, 8.0, 12.0, 245.0, 5.0

# Two-level limits of the screening gate: (metric, above, blocking limit, warning limit, texts) (fixed values).
TWO_LEVEL_RULES = [
    ("blur_score", False, 6.0, 45.0, "Image is too blurry for screening support.", "Image may be blurry."),
    ("brightness_mean", False, 20.0, 35.0, "Image is too dark for screening support.", "Image may be underexposed."),
    ("brightness_mean", True, 240.0, 220.0, "Image is too bright for screening support.", "Image may be overexposed."),
    ("contrast_std", False, 5.0, 12.0, "Image contrast is too low for screening support.", "Image contrast may be too low."),
    ("fundus_area_ratio", False, 0.025, 0.08, "Detected retinal field is too small.", "Detected retinal field is too small."),
]
MIN_SCORE = 50
BLOCKING_PENALTY = 18.0

# Advice and the substrings of the joined warnings that call for it (fixed values).
RETAKE_RULES = [
    (["blurry", "blur"], "Image too blurry. Please retake the image."),
    (["retinal field", "round enough"], "Retina not fully visible."),
    (["dark", "bright", "exposed", "contrast"], "Poor lighting detected."),
    (["too small", "boundary"], "Fundus coverage insufficient."),
]


def texts(pairs: Sequence[tuple[Column, str]]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(text)) for condition, text in pairs]))


def simple_flags(width: Column, height: Column, blur: Column, brightness: Column, contrast: Column) -> Column:
    return texts([
        ((width < SIMPLE_SIZE) | (height < SIMPLE_SIZE), "image_too_small"),
        (blur < SIMPLE_BLUR, "blurry"),
        (brightness < SIMPLE_DARK, "too_dark"),
        (brightness > SIMPLE_BRIGHT, "too_bright"),
        (contrast < SIMPLE_CONTRAST, "low_contrast"),
    ])


def simple_status(flags: Column, readable: Column) -> Column:
    joined = F.when(F.size(flags) == 0, "acceptable").otherwise(F.array_join(flags, ";"))
    return F.when(readable, joined).otherwise("unreadable")


def field_warnings(area_ratio: Column, circularity: Column, extent: Column, touches_border: Column,
                   saturation: Column, red_orange: Column, texture: Column, vessel_hint: Column) -> tuple[Column, Column]:
    """(warnings, blocking warnings) of the shape and colour rules."""
    full_frame = (area_ratio > 0.80) & (extent > 0.88)
    colour = (saturation >= 8.0) & (red_orange >= -25.0)
    odd_colour = ~colour & (vessel_hint < 0.001) & (texture < 8.0)
    warnings = texts([
        (area_ratio > 0.94, "Retinal field fills most of the image."),
        ((area_ratio <= 0.94) & touches_border & (area_ratio > 0.72),
         "Retinal field boundary could not be separated from background."),
        ((circularity >= 0.20) & (circularity < 0.38) & ~full_frame, "Detected retinal field is not round enough."),
        (~odd_colour & ((saturation < 18.0) | (red_orange < -5.0)), "Image does not match expected retinal color."),
        (vessel_hint < 0.0004, "Retinal vessel pattern is weak."),
    ])
    blocking = texts([
        ((circularity < 0.20) & ~full_frame, "Detected retinal field is not round enough."),
        (odd_colour, "Image does not match expected retinal color."),
    ])
    return warnings, blocking


def level_warnings(metrics: dict[str, Column]) -> tuple[Column, Column]:
    """(warnings, blocking warnings) of the two-level limits; a blocked metric does not also warn."""
    warn, block = [], []
    for name, above, hard, soft, hard_text, soft_text in TWO_LEVEL_RULES:
        m = metrics[name]
        blocked = m > hard if above else m < hard
        warned = m > soft if above else m < soft
        block.append((blocked, hard_text))
        warn.append((~blocked & warned, soft_text))
    return texts(warn), texts(block)


def quality_score(metrics: dict[str, Column], blocking_count: Column) -> Column:
    """0-100: weighted clipped components less a penalty per blocker, rounded half to even."""
    raw = (
        clip(metrics["blur_score"] / 90.0, 0.0, 1.0) * 22.0
        + clip(metrics["sharpness"] / 14.0, 0.0, 1.0) * 14.0
        + (1.0 - clip(F.abs(metrics["brightness_mean"] - 115.0) / 115.0, 0.0, 1.0)) * 20.0
        + clip(metrics["contrast_std"] / 45.0, 0.0, 1.0) * 18.0
        + (1.0 - clip(F.abs(metrics["signal_to_noise_ratio"] - 4.0) / 8.0, 0.0, 1.0)) * 10.0
        + clip(metrics["fundus_area_ratio"] / 0.55, 0.0, 1.0) * 16.0
    )
    return F.bround(clip(raw - blocking_count * BLOCKING_PENALTY, 0.0, 100.0), 0).cast("int")


def score_label(score: Column) -> Column:
    return F.when(score >= 80, "Good").when(score >= MIN_SCORE, "Acceptable").otherwise("Poor")


def two_level_gate(metrics: dict[str, Column], field: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """The gate as columns: ordered distinct warnings, score, label, acceptance.

    ``metrics`` needs blur_score, brightness_mean, contrast_std and fundus_area_ratio; sharpness and
    the signal-to-noise ratio follow from them. ``field`` adds the shape and colour warnings.
    """
    metrics = {
        **metrics,
        "sharpness": F.sqrt(F.greatest(metrics["blur_score"], F.lit(0.0))),
        "signal_to_noise_ratio": metrics["brightness_mean"] / F.greatest(metrics["contrast_std"], F.lit(1.0)),
    }
    warnings, blocking = level_warnings(metrics)
    if field:
        warnings, blocking = F.concat(field[0], warnings), F.concat(field[1], blocking)
    score = quality_score(metrics, F.size(blocking))
    return {
        "warnings": F.array_distinct(F.concat(blocking, warnings)),
        "n_blocking": F.size(blocking),
        "quality_score": score,
        "quality_label": score_label(score),
        "is_acceptable": (F.size(blocking) == 0) & (score >= MIN_SCORE),
    }


def feature_warnings(warnings: Column, vessel_density: Column, disc_detected: Column) -> Column:
    """Warnings extended by those known after feature extraction."""
    return F.array_distinct(F.concat(warnings, texts([
        (vessel_density < 0.001, "Retinal vessel pattern is not visible."),
        (~disc_detected, "Optic disc was not confidently localized."),
    ])))


def retake_advice(warnings: Column) -> Column:
    joined = F.lower(F.array_join(warnings, " "))
    rules = []
    for tokens, advice in RETAKE_RULES:
        hit = F.lit(False)
        for token in tokens:
            hit = hit | joined.contains(token)
        rules.append((hit, advice))
    return F.array_distinct(texts(rules))


def status_summary(warnings: Column, acceptable: Column) -> dict[str, Column]:
    """Overall, blur, brightness and contrast status from the joined warnings."""
    joined = F.lower(F.array_join(warnings, " "))
    dark = joined.contains("dark") | joined.contains("underexposed")
    bright = joined.contains("bright") | joined.contains("overexposed")
    return {
        "overall": F.when(acceptable, "acceptable").otherwise("poor"),
        "blur": F.when(joined.contains("blur"), "needs_retake").otherwise("acceptable"),
        "brightness": F.when(dark, "too_dark").when(bright, "too_bright").otherwise("acceptable"),
        "contrast": F.when(joined.contains("contrast"), "too_low").otherwise("acceptable"),
    }
