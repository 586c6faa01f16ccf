"""Table schemas and the fixed values results depend on.

Input files are read with these explicit schemas; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- raw inputs
# Raw files carry dates and times as text; parsing is a separate, total step.
PATIENTS_RAW = T.StructType([
    T.StructField("subject_id", T.LongType()),
    T.StructField("gender", T.StringType()),
    T.StructField("dob", T.StringType()),
])

ADMISSIONS_RAW = T.StructType([
    T.StructField("hadm_id", T.LongType()),
    T.StructField("subject_id", T.LongType()),
    T.StructField("admittime", T.StringType()),
    T.StructField("dischtime", T.StringType()),
    T.StructField("admission_type", T.StringType()),
])

NOTES_RAW = T.StructType([
    T.StructField("subject_id", T.LongType()),
    T.StructField("hadm_id", T.LongType()),
    T.StructField("charttime", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("text", T.StringType()),
])

DIAGNOSES_RAW = T.StructType([
    T.StructField("subject_id", T.LongType()),
    T.StructField("icd9_code", T.StringType()),   # text: leading zeros matter
])

ICUSTAYS_RAW = T.StructType([
    T.StructField("subject_id", T.LongType()),
    T.StructField("icustay_id", T.LongType()),
    T.StructField("los", T.DoubleType()),
])

# ------------------------------------------------------------ derived tables
BASE_FEATURES = [
    "admission_count", "avg_los_days", "max_los_days", "emergency_ratio",
    "days_since_last_admission", "has_previous_admission", "high_risk_label",
]

# Columns added to patient_features by the enrichment step, with their types;
# every one defaults to 0 when added to an existing table.
ADDED_FEATURE_TYPES = {
    "age": T.DoubleType(),
    "gender_male": T.IntegerType(),
    "charlson_score": T.DoubleType(),
    "num_diagnoses": T.IntegerType(),
    "num_icu_stays": T.IntegerType(),
    "total_icu_hours": T.DoubleType(),
    "had_icu": T.IntegerType(),
}
ADDED_FEATURES = list(ADDED_FEATURE_TYPES)

RISK_SCORES = T.StructType([
    T.StructField("subject_id", T.LongType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("risk_prediction", T.IntegerType()),
    T.StructField("risk_tier", T.StringType()),
    T.StructField("predicted_ward", T.StringType()),
    T.StructField("estimated_los_days", T.DoubleType()),
])

# Columns added to patient_risk_scores by the schema migration.
ADDED_SCORE_TYPES = {
    "predicted_ward": T.StringType(),
    "estimated_los_days": T.DoubleType(),
}

# ------------------------------------------------------------- model inputs
# Feature lists of the three models, in the reference's order.
BASIC_FEATURES = [
    "admission_count", "emergency_ratio", "days_since_last_admission",
    "has_previous_admission",
]
ENHANCED_FEATURES = [
    "admission_count", "emergency_ratio", "days_since_last_admission",
    "has_previous_admission", "age", "gender_male", "charlson_score",
    "num_diagnoses", "num_icu_stays", "total_icu_hours", "had_icu",
]
WARD_FEATURES = [
    "admission_count", "emergency_ratio", "avg_los_days", "max_los_days",
    "days_since_last_admission", "has_previous_admission", "risk_score",
]

# ------------------------------------------------------------- fixed values
# Charlson comorbidity conditions -> (ICD-9 prefixes, weight).
# Each condition counts once per patient; there is no hierarchy between the
# mild and severe forms. 17 conditions, 123 prefixes, weights sum to 33.
CHARLSON_CODES = {
    "myocardial_infarction": (["410", "412"], 1),
    "congestive_heart_failure": (["428"], 1),
    "peripheral_vascular": (["440", "441", "443", "444", "445"], 1),
    "cerebrovascular": (["430", "431", "432", "433", "434", "435", "436", "437", "438"], 1),
    "dementia": (["290"], 1),
    "chronic_pulmonary": (["490", "491", "492", "493", "494", "495", "496",
                           "500", "501", "502", "503", "504", "505"], 1),
    "connective_tissue": (["710", "714", "725"], 1),
    "peptic_ulcer": (["531", "532", "533", "534"], 1),
    "mild_liver": (["571", "573"], 1),
    "diabetes_uncomplicated": (["2500", "2501", "2502", "2503"], 1),
    "diabetes_complicated": (["2504", "2505", "2506", "2507", "2508", "2509"], 2),
    "hemiplegia": (["342", "343"], 2),
    "renal_disease": (["582", "583", "585", "586", "588"], 2),
    "cancer": (["140", "141", "142", "143", "144", "145", "146", "147",
                "148", "149", "150", "151", "152", "153", "154", "155",
                "156", "157", "158", "159", "160", "161", "162", "163",
                "164", "165", "166", "167", "168", "169", "170", "171",
                "172", "174", "175", "176", "177", "178", "179", "180",
                "181", "182", "183", "184", "185", "186", "187", "188",
                "189", "190", "191", "192", "193", "194", "195"], 2),
    "severe_liver": (["5722", "5723", "5724", "5728"], 3),
    "metastatic_cancer": (["196", "197", "198", "199"], 6),
    "aids": (["042", "043", "044"], 6),
}

# Ward -> clinical context line used in discharge prompts.
WARD_CONTEXT = {
    "ICU": "Intensive Care Unit — requires continuous monitoring, ventilator possible",
    "MICU": "Medical ICU — step-down from ICU, close monitoring required",
    "Private": "Private Room — stable but needs individual nursing attention",
    "General": "General Ward — routine monitoring, approaching discharge readiness",
}
WARD_CONTEXT_DEFAULT = "General Ward"

# Risk tier bins, right-closed: (0, .3] LOW, (.3, .6] MEDIUM, (.6, 1] HIGH.
TIER_EDGES = [(0.0, 0.3, "LOW"), (0.3, 0.6, "MEDIUM"), (0.6, 1.0, "HIGH")]
TIERS = ["HIGH", "MEDIUM", "LOW"]

# Label threshold on mean stay (days, strict) and age cap (years).
HIGH_RISK_MEAN_STAY_DAYS = 6.5
AGE_CAP_YEARS = 90
DAYS_PER_YEAR = 365.25
US_PER_DAY = 86_400_000_000


def charlson_rows() -> list[tuple[str, str, int]]:
    """(condition, prefix, weight) rows of the lookup table."""
    return [(cond, p, w) for cond, (prefixes, w) in CHARLSON_CODES.items() for p in prefixes]
