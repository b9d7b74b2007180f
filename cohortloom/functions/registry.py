"""Names, limits, orders and labels that results depend on."""

from __future__ import annotations

# Cohorts in registry order with display name and access class.
COHORTS = {
    "abide": ("ABIDE", "approval-required"),
    "adni": ("ADNI", "restricted"),
    "oasis3": ("OASIS-3", "restricted"),
    "camcan": ("Cam-CAN", "approval-required"),
    "cobre": ("COBRE", "approval-required"),
    "adnidod": ("ADNI-DOD", "restricted"),
}
COHORT_ORDER = ["cobre", "adnidod", "camcan", "abide", "oasis3", "adni"]
COHORT_ALIASES = {"oasis-3": "oasis3", "cam-can": "camcan", "adni-dod": "adnidod"}

# Atlases with region count and representation.
ATLASES = {"schaefer_100": (100, "labels"), "msdl_39": (39, "maps")}
ATLAS_ALIASES = {
    "schaefer100": "schaefer_100",
    "schaefer-100": "schaefer_100",
    "msdl": "msdl_39",
    "msdl39": "msdl_39",
    "msdl-39": "msdl_39",
}
SAFE_NAME = "^[a-z0-9][a-z0-9_-]*$"

# Quality limits, jitter, seeds and fold counts.
MIN_LENGTH = 100
MIN_CONDITION = 10.0
MAX_CONDITION = 1e6
MAX_NULL_REGIONS = 0
FIRST_KEPT_POINT = 5
COVARIANCE_EPS = 1e-5
SYMMETRY_TOLERANCE = 1e-7
RELEASE_TOLERANCE = 1e-8
EIGENVALUE_FLOOR = 1e-4
VALIDATION_SHARE = 0.1
SEED = 1
SHUFFLE_SEED = 42
DEBUG_ROWS = 50
OUTER_FOLDS = 5
INNER_FOLDS = 5
RIDGE_ALPHAS = [1e-3, 1e-2, 0.1, 1.0, 10.0, 100.0, 1000.0]
AGE_BOUNDS = (0.0, 120.0)

# Metric names, all and per protocol.
METRICS = ["MAE", "RMSE", "R2", "MSE", "Pearson_r", "Spearman_rho", "corr(BAG,age)", "age_bias_slope"]
GROUPED_METRICS = ["MAE", "R2", "Pearson_r"]
LODO_METRICS = ["MAE", "R2", "Pearson_r", "Spearman_rho", "corr(BAG,age)", "age_bias_slope"]

# Model and harmonization orders of the result tables.
MODEL_ORDER = ["Dummy", "CorrVec", "Ridge", "SPDNet"]
HARMONIZATION_ORDER = ["original", "harmonized"]

# File-name parts that identify a model, single-cohort and pooled forms.
SINGLE_FILE_PARTS = {
    "Dummy": ["dummy_agereg_"],
    "Ridge": ["ridge_agereg_ts_"],
    "SPDNet": ["spdnet_agereg_"],
    "VecCorrRidge": ["corrvec_ridge_agereg", "ridge_agereg_veccorr"],
}
POOLED_FILE_PARTS = {
    "Dummy": ["dummy_agereg_"],
    "Ridge": ["ridge_agereg_ts_"],
    "SPDNet": ["spdnet_agereg_"],
    "VecCorrRidge": ["corrvec_ridge_agereg_"],
}
VARIANT_PARTS = {
    "quarterdim": ["quarterdim"],
    "halfdim": ["halfdim"],
    "one": ["one", "base"],
    "two": ["two", "2layer"],
}

# Panels of the pooled result figure (experiment, metric, negated).
RESULT_PANELS = [
    ("GKF5", "MAE", True),
    ("LODO", "MAE", True),
    ("GKF5", "R2", False),
    ("LODO", "R2", False),
    ("LODO", "Spearman_rho", False),
]
POINT_PREFIX = {"GKF5": "R", "LODO": "TEST_"}

# Per-cohort diagnosis labels.
DIAGNOSIS_LABELS = {
    "abide": {"0": "control", "1": "ASD"},
    "adnidod": {"0": "PTSD-negative", "1": "PTSD-positive"},
    "cobre": {"0": "control", "1": "schizophrenia"},
    "oasis3": {
        "0.0": "CDR 0: cognitively normal",
        "0.5": "CDR 0.5: very mild impairment",
        "1.0": "CDR 1: mild dementia",
        "2.0": "CDR 2: moderate dementia",
        "3.0": "CDR 3: severe dementia",
    },
}
DIAGNOSIS_PRIORITY = [
    "CN", "SMC", "MCI", "AD",
    "CDR 0: cognitively normal", "CDR 0.5: very mild impairment", "CDR 1: mild dementia",
    "CDR 2: moderate dementia", "CDR 3: severe dementia",
    "control", "ASD", "PTSD-negative", "PTSD-positive", "schizophrenia",
    "no diagnosis label retained",
]
# Cohorts (lower case) with an order of their own, and those of them that show 'missing'.
DIAGNOSIS_PRIORITY_OF = {
    "adni": ["CN", "SMC", "MCI", "AD"],
    "oasis3": [
        "CDR 0: cognitively normal", "CDR 0.5: very mild impairment", "CDR 1: mild dementia",
        "CDR 2: moderate dementia", "CDR 3: severe dementia",
    ],
}
DIAGNOSIS_MISSING_SHOWN = ["adni"]
# Labels as shown in figures; others are shown as they are.
DIAGNOSIS_SHOWN = {
    "CDR 0: cognitively normal": "cognitively\nnormal",
    "CDR 0.5: very mild impairment": "very mild\nimpairment",
    "CDR 1: mild dementia": "mild\ndementia",
    "CDR 2: moderate dementia": "moderate",
    "CDR 3: severe dementia": "severe",
}
# Progression rank of a diagnosis label in lower case; anything else ranks 6.
DIAGNOSIS_PROGRESSION = {
    "control": 0, "cn": 0, "cdr 0: cognitively normal": 0, "ptsd-negative": 0,
    "smc": 1, "cdr 0.5: very mild impairment": 1,
    "asd": 2, "mci": 2, "cdr 1: mild dementia": 2, "schizophrenia": 2, "ptsd-positive": 2,
    "ad": 3, "cdr 2: moderate dementia": 3,
    "cdr 3: severe dementia": 4,
    "missing": 5, "no diagnosis label retained": 5,
}

# Harmonization policy per protocol (fit scope, applied to test, test target used, label).
HARMONIZATION_POLICY = {
    "kfold": ("outer_train", True, True, "known_dataset_known_age_test"),
    "lodo": ("outer_train", False, False, "source_only"),
}

# Ridgeline density settings.
DENSITY_BANDWIDTH_FACTOR = 0.9
DENSITY_CLIP = (0.0, 105.0)
DENSITY_POINTS = 200
DENSITY_SCALE = 2.2
STRIP_ROWS = 4500

# Columns and tables that may never leave with aggregate outputs.
IDENTIFIER_COLUMNS = ["subjectid", "subject_id", "scan_id", "session"]
