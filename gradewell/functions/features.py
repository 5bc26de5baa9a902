"""Derived feature columns as plain expressions over a wide table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.numeric import finite, mean_of, ratio_abs_floor_one, ratio_epsilon, ratio_floor_one, spread_of, total
from gradewell.operators.profile import exact_quantiles
from gradewell.session import store


def reader(df: DataFrame) -> Callable[[str], Column]:
    """Column by name: absent columns, missing and non-finite cells count as 0."""
    present = set(df.columns)
    return lambda name: F.coalesce(finite(F.col(name).cast("double")), F.lit(0.0)) if name in present else F.lit(0.0)


def log1p_floor(value: Column) -> Column:
    return F.log1p(F.greatest(value, F.lit(0.0)))


def burden_features(df: DataFrame) -> dict[str, Column]:
    """Ten burden features from the base measurements."""
    get = reader(df)

    def added(*names: str) -> Column:
        return total([get(n) for n in names])

    bright_area = added("exudate_area", "hard_exudate_area", "soft_exudate_area")
    bright_count = added("exudate_count", "hard_exudate_count", "soft_exudate_count")
    bleed_area, bleed_count = get("hemorrhage_area"), get("hemorrhage_count")
    length = added("vessel_length", "vessel_skeleton_length")
    count = get("ma_count") + bright_count + bleed_count + get("cotton_wool_count")
    area = get("ma_area") + bright_area + bleed_area + get("cotton_wool_area")
    lesion = log1p_floor(area) + log1p_floor(count)
    bright = log1p_floor(bright_area) + added("exudate_density", "hard_exudate_coverage_pct")
    bleed = log1p_floor(bleed_area) + get("hemorrhage_density")
    advanced = added("advanced_dr_indicator_score", "neovascularization_likelihood_score", "referable_lesion_score",
                     "stage_progression_score")
    tangle = added("vessel_complexity_score", "vessel_fragmentation_index", "vessel_tortuosity_mean", "vessel_tortuosity_std")
    return {
        "lesion_burden": lesion,
        "exudate_burden": bright,
        "hemorrhage_burden": bleed,
        "vessel_abnormality": tangle + ratio_abs_floor_one(bleed_area, length),
        "ma_density_score": added("ma_density", "ma_density_per_retinal_area") + ratio_abs_floor_one(get("ma_count"), count),
        "exudate_to_ma": ratio_abs_floor_one(bright_area, get("ma_area")) + ratio_abs_floor_one(bright_count, get("ma_count")),
        "hemorrhage_to_vessel": ratio_abs_floor_one(bleed_area, length)
        + ratio_abs_floor_one(bleed_count, added("vessel_density", "vessel_area_ratio")),
        "total_lesion_count": count,
        "total_lesion_area": area,
        "referable_pathology": lesion + 1.4 * bleed + 1.2 * bright + 1.6 * advanced,
    }


def severity_features(df: DataFrame, field_area: str = "fov_area") -> dict[str, Column]:
    """Eight severity scores from counts and areas."""
    get = reader(df)
    field = F.greatest(get(field_area), F.lit(1.0))
    vessel = get("vessel_tortuosity_mean") + get("vessel_fragmentation_index") * 100.0 + get("vessel_curvature_mean")
    bright = get("exudate_density") + get("soft_exudate_coverage_pct") / 100.0
    return {
        "total_lesion_count": total([get(n) for n in ("ma_count", "exudate_count", "hemorrhage_count", "cotton_wool_count")]),
        "combined_lesion_burden": get("combined_lesion_area"),
        "lesion_density_score": get("combined_lesion_area") / field,
        "hemorrhage_to_ma_ratio": ratio_floor_one(get("hemorrhage_count"), get("ma_count")),
        "vessel_abnormality_score": vessel,
        "exudate_burden_score": bright,
        "advanced_dr_indicator_score": get("hemorrhage_count") * 0.5 + get("cotton_wool_count") * 0.7 + bright * 100.0 + vessel,
        "neovascularization_likelihood_score": get("vessel_branchpoint_count") * get("vessel_tortuosity_mean")
        / F.greatest(get(field_area) / 10000.0, F.lit(1.0)),
    }


def interaction_features(df: DataFrame, field_area: str = "fov_area") -> dict[str, Column]:
    """Ten interactions; the severity scores must already be columns."""
    get = reader(df)
    density = get("lesion_density_score")
    per_area = F.greatest(get(field_area) / 10000.0, F.lit(1.0))
    return {
        "ma_to_exudate_ratio": ratio_floor_one(get("ma_count"), get("exudate_count")),
        "hemorrhage_to_exudate_ratio": ratio_floor_one(get("hemorrhage_count"), get("exudate_count")),
        "lesion_vessel_interaction": density * get("vessel_density"),
        "texture_lesion_interaction": density * get("glcm_contrast"),
        "quality_adjusted_lesion_density": density * (F.greatest(get("quality_contrast"), F.lit(1.0)) / 50.0),
        "area_adjusted_ma_count": get("ma_count") / per_area,
        "area_adjusted_exudate_count": get("exudate_count") / per_area,
        "area_adjusted_hemorrhage_count": get("hemorrhage_count") / per_area,
        "referable_lesion_score": get("exudate_burden_score") + get("hemorrhage_to_ma_ratio") + density,
        "stage_progression_score": get("advanced_dr_indicator_score") + get("vessel_abnormality_score"),
    }


QUALITY_COLUMNS = ["quality_contrast", "quality_brightness", "quality_blur_score"]


def quality_cuts(df: DataFrame) -> dict[str, tuple[float, float]]:
    """10 % and 90 % quantiles of the quality columns over the whole table (absent columns count as 0)."""
    get = reader(df)
    filled = store(df.select(*[get(c).alias(c) for c in QUALITY_COLUMNS]))
    rows = exact_quantiles(filled, QUALITY_COLUMNS, [0.10, 0.90]).collect()
    found = {(r["feature"], r["q"]): r["value"] for r in rows}
    return {c: (found[(c, 0.10)], found[(c, 0.90)]) for c in QUALITY_COLUMNS}


def study_features(df: DataFrame, cuts: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """Thirty-nine composite features; ``cuts`` come from :func:`quality_cuts` on the fitting table."""
    get = reader(df)
    directions = ("0", "45", "90", "135")
    contrast = [get(f"glcm_contrast_{d}") for d in directions]
    energy = [get(f"glcm_energy_{d}") for d in directions]
    sides = [get(f"ma_{side}_count") for side in ("superior", "inferior", "nasal", "temporal")]
    bright_area = get("hard_exudate_area") + get("soft_exudate_area") + get("cotton_wool_area")
    bright_count = get("hard_exudate_count") + get("soft_exudate_count") + get("cotton_wool_count")
    red_area, red_count = get("ma_area") + get("hemorrhage_area"), get("ma_count") + get("hemorrhage_count")
    quality = get("quality_blur_score") + get("quality_contrast") + 1.0

    def flag(condition: Column) -> Column:
        return condition.cast("double")

    spread = total([flag(s > 0) for s in sides])
    severity = F.log1p(get("hemorrhage_area")) * F.log1p(get("hemorrhage_count") + 1.0)

    def near(place: str) -> Column:
        return get(f"hard_exudate_distance_to_{place}_mean") + get(f"soft_exudate_distance_to_{place}_mean") + 1.0

    return {
        "study_glcm_contrast_mean_directional": mean_of(contrast),
        "study_glcm_contrast_range_directional": spread_of(contrast),
        "study_glcm_energy_mean_directional": mean_of(energy),
        "study_glcm_energy_range_directional": spread_of(energy),
        "study_glcm_asm_proxy": get("glcm_energy") * get("glcm_energy"),
        "study_glcm_homogeneity_contrast_ratio": ratio_epsilon(get("glcm_homogeneity"), get("glcm_contrast")),
        "study_glcm_entropy_correlation_interaction": get("glcm_entropy") * get("glcm_correlation"),
        "study_lbp_entropy_uniform_ratio": ratio_epsilon(get("lbp_entropy"), get("lbp_uniform_ratio") + 1.0),
        "study_lbp_variation_index": ratio_epsilon(get("lbp_std"), F.abs(get("lbp_mean")) + 1.0),
        "study_lbp_texture_stability": ratio_epsilon(get("lbp_uniform_ratio"), get("lbp_entropy") + 1.0),
        "study_texture_contrast_lbp_interaction": get("glcm_contrast") * get("lbp_entropy"),
        "study_bright_lesion_total_area_log": F.log1p(bright_area),
        "study_bright_lesion_total_count_log": F.log1p(bright_count),
        "study_bright_lesion_mean_area": ratio_epsilon(bright_area, bright_count + 1.0),
        "study_exudate_macula_risk": ratio_epsilon(bright_area, near("macula")),
        "study_exudate_optic_disc_fp_risk": ratio_epsilon(bright_area, near("optic_disc")),
        "study_hard_soft_exudate_balance": ratio_epsilon(get("hard_exudate_area"), get("soft_exudate_area") + 1.0),
        "study_red_lesion_total_area_log": F.log1p(red_area),
        "study_red_lesion_total_count_log": F.log1p(red_count),
        "study_red_lesion_density_combined": get("ma_density") + get("hemorrhage_density"),
        "study_ma_presence_strength": F.log1p(get("ma_count")) * F.log1p(get("ma_area")),
        "study_ma_quadrant_spread": spread,
        "study_ma_quadrant_asymmetry": spread_of(sides),
        "study_hemorrhage_severity_index": severity,
        "study_hemorrhage_retina_extent_index": get("hemorrhage_area") * get("hemorrhage_retina_affected_pct"),
        "study_hemorrhage_ma_ratio_log": F.log1p(ratio_epsilon(get("hemorrhage_area") + 1.0, get("ma_area") + 1.0)),
        "study_vessel_branching_density": ratio_epsilon(get("vessel_branching_count"), get("vessel_length") + 1.0),
        "study_vessel_width_tortuosity_index": get("vessel_average_width")
        * (get("vessel_tortuosity_mean") + get("vessel_curvature_mean")),
        "study_vessel_complexity_density_ratio": ratio_epsilon(get("vessel_complexity_score"), get("vessel_density") + 0.001),
        "study_vessel_fragmentation_density": get("vessel_fragmentation_index") * get("vessel_density"),
        "study_quality_low_contrast_flag": flag(get("quality_contrast") < cuts["quality_contrast"][0]),
        "study_quality_dark_flag": flag(get("quality_brightness") < cuts["quality_brightness"][0]),
        "study_quality_bright_flag": flag(get("quality_brightness") > cuts["quality_brightness"][1]),
        "study_quality_blur_flag": flag(get("quality_blur_score") < cuts["quality_blur_score"][0]),
        "study_quality_adjusted_red_lesion": ratio_epsilon(red_area, quality),
        "study_quality_adjusted_bright_lesion": ratio_epsilon(bright_area, quality),
        "study_referable_safety_score": get("referable_lesion_score") + get("stage_progression_score")
        + get("advanced_dr_indicator_score"),
        "study_severe_npdr_score": severity + get("vessel_abnormality_score") + spread,
        "study_pdr_support_score": get("neovascularization_likelihood_score") + get("vessel_abnormality_score")
        + get("advanced_dr_indicator_score"),
    }


def group_of(feature: Column) -> Column:
    """Group of a feature by name; the first matching rule counts."""
    def has(*tokens: str) -> Column:
        hit = F.lit(False)
        for token in tokens:
            hit = hit | feature.contains(token)
        return hit

    return (
        F.when(feature.startswith("vessel_"), "vessel")
        .when(feature.startswith("hemorrhage"), "lesion_hemorrhage")
        .when(feature.startswith("ma_"), "lesion_microaneurysm")
        .when(has("exudate", "cotton_wool", "bright_lesion"), "lesion_exudate")
        .when(has("glcm"), "texture_glcm")
        .when(has("lbp", "texture", "wavelet", "fft"), "texture_lbp")
        .when(feature.startswith("quality_"), "quality")
        .when(has("optic_disc"), "optic_disc")
        .otherwise("existing")
    )


# Column prefixes of tables merged from several extractors, with their group.
HYBRID_GROUPS = [
    ("handcrafted__", "handcrafted"),
    ("selected75__", "selected_75"),
    ("selected100__", "selected_100"),
    ("cnn_embedding__", "embedding"),
]


def hybrid_group_of(feature: Column, groups: list[tuple[str, str]] = HYBRID_GROUPS) -> Column:
    """Group of a column of a table merged from several extractors, by prefix; the first match counts."""
    group = F.lit("image_prediction")
    for prefix, name in reversed(groups):
        group = F.when(feature.startswith(prefix), name).otherwise(group)
    return group


def select_features(df: DataFrame, names: list[str], fallbacks: dict[str, Column] | None = None) -> list[Column]:
    """Columns in the asked order; missing cells take the fallback expression or 0. Unknown names raise."""
    fallbacks = fallbacks or {}
    unknown = [n for n in names if n not in df.columns and n not in fallbacks]
    if unknown:
        raise ValueError(f"features not available: {unknown[:10]}")
    out = []
    for name in names:
        sources = ([finite(F.col(name).cast("double"))] if name in df.columns else []) + (
            [fallbacks[name]] if name in fallbacks else [])
        out.append(F.coalesce(*sources, F.lit(0.0)).alias(name))
    return out
