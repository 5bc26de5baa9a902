"""Fixed values of the screening domain: they must equal the published ones for equal results."""

SEED = 42

# Grades and names (fixed values).
GRADES = [0, 1, 2, 3, 4]
GRADE_NAMES = {
    0: "No apparent diabetic retinopathy",
    1: "Mild non-proliferative diabetic retinopathy",
    2: "Moderate non-proliferative diabetic retinopathy",
    3: "Severe non-proliferative diabetic retinopathy",
    4: "Proliferative diabetic retinopathy",
}
POSITIVE_MIN_GRADE = 2

# Label and id column names, in order of preference (fixed values).
ID_COLUMNS = ["id_code", "image", "image_id", "filename", "file_name", "path"]
LABEL_COLUMNS = ["diagnosis", "label", "grade", "dr_grade", "class"]

# Known object extensions in order of preference (fixed values).
EXTENSIONS = [".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff"]

# Text labels after normalisation (fixed values).
LABEL_SYNONYMS = {
    "healthy": 0,
    "normal": 0,
    "no_dr": 0,
    "no_diabetic_retinopathy": 0,
    "no_apparent_dr": 0,
    "no_apparent_diabetic_retinopathy": 0,
    "mild": 1,
    "mild_dr": 1,
    "mild_non_proliferative_diabetic_retinopathy": 1,
    "moderate": 2,
    "moderate_dr": 2,
    "moderate_non_proliferative_diabetic_retinopathy": 2,
    "severe": 3,
    "severe_dr": 3,
    "severe_non_proliferative_diabetic_retinopathy": 3,
    "proliferative": 4,
    "proliferative_dr": 4,
    "proliferate_dr": 4,
    "pdr": 4,
    "proliferative_diabetic_retinopathy": 4,
}

# Deterministic score per grade (fixed values).
GRADE_SCORES = {0: 0.0, 1: 25.0, 2: 55.0, 3: 80.0, 4: 95.0}

# Cut points of ordinal scores (fixed values).
CUTS_DEFAULT = [0.5, 1.5, 2.5, 3.5]
CUTS_ADJUSTED = [0.7, 1.5, 2.5, 3.5]
CUTS_REGRESSION = [1.0, 1.6, 2.1, 3.1]

# Threshold grids, written out (fixed values).
THRESHOLDS_TRAINING = [0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60]
THRESHOLDS_STUDY = [0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]
THRESHOLDS_EXPANDED = [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]
UNCERTAINTY_BANDS = [(0.40, 0.60), (0.35, 0.65), (0.30, 0.70), (0.25, 0.75)]
LOW_CONFIDENCE = 0.60
DEFAULT_THRESHOLD = 0.20

# Baselines of the promotion gates (fixed values).
SAFE_GRADING_BASELINE = {
    "accuracy": 0.6602,
    "balanced_accuracy": 0.6083,
    "macro_f1": 0.5718,
    "class_1_recall": 0.4533,
    "class_3_recall": 0.6400,
    "class_4_recall": 0.6233,
}
PRODUCTION_BASELINE = {
    "accuracy": 0.6798,
    "balanced_accuracy": 0.5312,
    "macro_f1": 0.5077,
    "class_1_recall": 0.3299,
    "class_3_recall": 0.3095,
    "class_4_recall": 0.6151,
    "recall": 0.9373,
    "false_negatives": 88,
}
SAFETY_RECALL = 0.9646
SAFETY_FALSE_NEGATIVES = 56
FALSE_POSITIVE_LIMIT = 900
UNCERTAIN_SHARE_LIMIT = 0.35
TARGET_RECALL = 0.9570345408593092
TARGET_FALSE_POSITIVES = 398

# Governed selection: labels in priority order, totals to reach (fixed values).
SELECTION_PRIORITY = [3, 1, 4]
SELECTION_TOTALS = {1: 1500, 3: 1000, 4: 1500}
SOURCE_RANKS = {"IDRiD grading": 0, "Sachin Kumar": 1, "Diabetic_Retinopathy_Balanced": 2}

# Name hints of acquisition columns and of rare finding columns (fixed values).
ACQUISITION_HINTS = ["quality_", "brightness", "blur", "sharpness", "contrast", "snr"]
FINDING_TOKENS = [
    "ma",
    "microaneurysm",
    "red_lesion",
    "hemorrhage",
    "exudate",
    "cotton_wool",
    "bright_lesion",
    "optic_disc",
    "neovascular",
]
LEGACY_FEATURES = [
    "ma_count",
    "exudate_area",
    "vessel_density",
    "glcm_contrast",
    "glcm_homogeneity",
    "glcm_energy",
]
INTEGER_PARAMS = [
    "depth",
    "iterations",
    "max_depth",
    "max_iter",
    "max_leaf_nodes",
    "min_child_samples",
    "min_samples_leaf",
    "min_samples_split",
    "n_estimators",
    "num_leaves",
]
