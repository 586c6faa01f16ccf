"""Per-patient feature table: stay statistics, age, comorbidity, ICU burden.

Every block is keyed by ``subject_id`` and pre-aggregated before it is
joined, so the merge is a chain of joins on one key: each input is shuffled
once, and a patient with a third of all rows costs one row per map task after
partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath import schemas as S
from carepath.functions import scalar as X
from carepath.operators.clean import project_admissions, project_patients

AS_OF = "2002-01-01 00:00:00"
_MEAN_STAY_LIMIT_US = int(S.HIGH_RISK_MEAN_STAY_DAYS * S.US_PER_DAY)


def filter_complete_stays(admissions: DataFrame) -> DataFrame:
    return admissions.filter(F.col("admittime").isNotNull() & F.col("dischtime").isNotNull())


def admission_stats(admissions: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Partial per-patient sums over complete stays (before any join)."""
    stay_us = X.micros_between("admittime", "dischtime")
    return (filter_complete_stays(admissions)
            .groupBy("subject_id")
            .agg(F.count("hadm_id").alias("admission_count"),
                 F.count(F.lit(1)).alias("n_stays"),
                 F.sum(stay_us).alias("sum_stay_us"),
                 F.max(stay_us).alias("max_stay_us"),
                 F.sum(X.flag(F.col("admission_type") == "EMERGENCY")).alias("n_emergency"),
                 F.max("admittime").alias("last_admit")))


def patient_features(patients: DataFrame, admissions: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """One row per patient with at least one complete stay (flagship).

    Means are taken as one exact integer sum divided once, so the label
    ``mean stay > 6.5 days`` is decided in integer microseconds and does not
    depend on summation order.
    """
    st = admission_stats(admissions, as_of)
    # an outer join filtered on the right side is an inner join; write it so
    j = patients.select("subject_id").join(st, "subject_id", "inner")
    n = F.col("n_stays")
    return j.select(
        "subject_id",
        F.col("admission_count"),
        (F.col("sum_stay_us").cast("double") / n / F.lit(float(S.US_PER_DAY))).alias("avg_los_days"),
        X.days_from_micros(F.col("max_stay_us")).alias("max_los_days"),
        X.safe_ratio(F.col("n_emergency"), F.col("admission_count")).alias("emergency_ratio"),
        X.days_since("last_admit", as_of).alias("days_since_last_admission"),
        X.flag(F.col("admission_count") > 1).alias("has_previous_admission"),
        X.flag(F.col("sum_stay_us") > n * F.lit(_MEAN_STAY_LIMIT_US)).alias("high_risk_label"),
    )


# ---------------------------------------------------------------- enrichment
def first_admission(admissions_raw: DataFrame) -> DataFrame:
    """Earliest parsable admission time per patient, over the whole export."""
    adm = project_admissions(admissions_raw)
    return adm.groupBy("subject_id").agg(F.min("admittime").alias("first_admit"))


def age_features(patients_raw: DataFrame, admissions_raw: DataFrame) -> DataFrame:
    """Age at first admission and gender flag; rows without an age are dropped.

    The export can repeat a patient; enrichment writes rows in file order, so
    the *last* row per patient is the one that stands.
    """
    pat = project_patients(patients_raw)
    merged = pat.join(first_admission(admissions_raw), "subject_id", "left")
    rows = merged.select(
        "subject_id", "seq",
        X.age_years("first_admit", "dob").alias("age"),
        X.encode_gender("gender").alias("gender_male"),
    ).dropna(subset=["subject_id", "age"])
    last = F.max(F.struct("seq", "age", "gender_male")).alias("_last")
    return (rows.groupBy("subject_id").agg(last)
                .select("subject_id", F.col("_last.age").alias("age"),
                        F.col("_last.gender_male").alias("gender_male")))


def charlson_lookup(spark: SparkSession) -> DataFrame:
    """(prefix, condition, weight): 123 rows, a fixed-size broadcast side."""
    rows = [(p, c, w) for c, p, w in S.charlson_rows()]
    return spark.createDataFrame(rows, "prefix string, condition string, weight int")


def diagnosis_codes(diagnoses_raw: DataFrame) -> DataFrame:
    """Distinct (patient, raw code) pairs: shared by both code features. A missing code stays, so
    that a patient with no other counts zero codes instead of none."""
    return (diagnoses_raw.select("subject_id", F.col("icd9_code").cast("string").alias("icd9_code"))
                         .dropna(subset=["subject_id"]).distinct())


def prefix_join_charlson(codes: DataFrame, lookup: DataFrame) -> DataFrame:
    """Codes matched to Charlson conditions by prefix, as an equi join.

    Prefixes are 3 or 4 characters long, so each code contributes its two
    leading substrings and joins the lookup on equality; the lookup is a
    fixed 123-row table and is broadcast (no nested-loop theta join).
    """
    code = X.clean_code("icd9_code")
    cand = codes.select("subject_id", F.explode(F.array_distinct(F.array(
        F.substring(code, 1, 3), F.substring(code, 1, 4)))).alias("prefix"))
    return cand.join(F.broadcast(lookup), "prefix")


def charlson_score(codes: DataFrame, lookup: DataFrame) -> DataFrame:
    """Sum of weights of the distinct conditions each patient has."""
    hits = prefix_join_charlson(codes, lookup).select("subject_id", "condition", "weight").distinct()
    return hits.groupBy("subject_id").agg(F.sum("weight").cast("double").alias("charlson_score"))


def num_diagnoses(codes: DataFrame) -> DataFrame:
    """Distinct raw (unstripped) codes per patient."""
    return codes.groupBy("subject_id").agg(F.count("icd9_code").cast("int").alias("num_diagnoses"))


def icu_features(icustays: DataFrame) -> DataFrame:
    """ICU stay count (non-null ids), summed length (unscaled, 0 if all null), flag."""
    return (icustays.groupBy("subject_id")
            .agg(F.count("icustay_id").cast("int").alias("num_icu_stays"),
                 X.stable(F.coalesce(F.sum("los"), F.lit(0.0))).alias("total_icu_hours"),
                 F.lit(1).alias("had_icu")))


def merge_feature_blocks(age: DataFrame, charlson: DataFrame, diag: DataFrame,
                         icu: DataFrame) -> DataFrame:
    """age ⟕ charlson ⟕ diagnosis count ⟕ ICU, all on subject_id; gaps become 0."""
    out = (age.join(charlson, "subject_id", "left")
              .join(diag, "subject_id", "left")
              .join(icu, "subject_id", "left"))
    return out.select(
        "subject_id", "age", "gender_male",
        F.coalesce("charlson_score", F.lit(0.0)).alias("charlson_score"),
        F.coalesce("num_diagnoses", F.lit(0)).alias("num_diagnoses"),
        F.coalesce("num_icu_stays", F.lit(0)).alias("num_icu_stays"),
        F.coalesce("total_icu_hours", F.lit(0.0)).alias("total_icu_hours"),
        F.coalesce("had_icu", F.lit(0)).alias("had_icu"),
    )


def enhanced_features(spark: SparkSession, patients_raw: DataFrame, admissions_raw: DataFrame,
                      diagnoses_raw: DataFrame, icustays_raw: DataFrame) -> DataFrame:
    codes = diagnosis_codes(diagnoses_raw)
    return merge_feature_blocks(age_features(patients_raw, admissions_raw),
                                charlson_score(codes, charlson_lookup(spark)),
                                num_diagnoses(codes), icu_features(icustays_raw))
