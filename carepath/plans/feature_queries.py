"""Joins and per-patient aggregations."""

from __future__ import annotations

from carepath.functions import scalar as X
from carepath.operators import features as FE
from carepath.plans.catalog import register
from carepath.plans.context import Clinic

FEATURE_COLS = ("subject_id, admission_count, avg_los_days, max_los_days, emergency_ratio, "
                "days_since_last_admission, has_previous_admission, high_risk_label")


@register("patient_features", f"SELECT {FEATURE_COLS} FROM patient_features")
def q_patient_features(spark, sf_dir):
    return Clinic(spark, sf_dir).base_features


@register("join_patient_stays", """
SELECT p.subject_id, a.hadm_id, epoch_us(a.dischtime) - epoch_us(a.admittime) AS stay_us
FROM patients p LEFT JOIN admissions a ON p.subject_id = a.subject_id
WHERE a.dischtime IS NOT NULL AND a.admittime IS NOT NULL""")
def q_join_patient_stays(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    a = FE.filter_complete_stays(c.admissions)
    return (c.patients.select("subject_id").join(a, "subject_id", "inner")
            .select("subject_id", "hadm_id", X.micros_between("admittime", "dischtime").alias("stay_us")))


@register("first_admission", "SELECT subject_id, first_admit FROM first_admit")
def q_first_admission(spark, sf_dir):
    return FE.first_admission(Clinic(spark, sf_dir).admissions_raw)


@register("left_first_admit", """
SELECT p.subject_id, p.seq, f.first_admit FROM patients_raw p LEFT JOIN first_admit f ON p.subject_id = f.subject_id""")
def q_left_first_admit(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    return (c.patients_raw.select("subject_id", "seq")
            .join(FE.first_admission(c.admissions_raw), "subject_id", "left")
            .select("subject_id", "seq", "first_admit"))


@register("age_features", "SELECT subject_id, age, gender_male FROM age_block")
def q_age_features(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    return FE.age_features(c.patients_raw, c.admissions_raw)


@register("prefix_join_charlson", """
SELECT DISTINCT d.subject_id, l.condition, l.weight
FROM diag_codes d JOIN charlson_lookup l ON starts_with(trim(d.icd9_code), l.prefix)""")
def q_prefix_join_charlson(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    codes = FE.diagnosis_codes(c.diagnoses_raw)
    return (FE.prefix_join_charlson(codes, FE.charlson_lookup(spark))
            .select("subject_id", "condition", "weight").distinct())


@register("charlson_score", "SELECT subject_id, charlson_score FROM charlson")
def q_charlson_score(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    return FE.charlson_score(FE.diagnosis_codes(c.diagnoses_raw), FE.charlson_lookup(spark))


@register("num_diagnoses", "SELECT subject_id, num_diagnoses FROM ndiag")
def q_num_diagnoses(spark, sf_dir):
    return FE.num_diagnoses(FE.diagnosis_codes(Clinic(spark, sf_dir).diagnoses_raw))


@register("icu_features", "SELECT subject_id, num_icu_stays, total_icu_hours, had_icu FROM icu")
def q_icu_features(spark, sf_dir):
    return FE.icu_features(Clinic(spark, sf_dir).icustays_raw)


@register("merge_feature_blocks", "SELECT * FROM enhanced")
def q_merge_feature_blocks(spark, sf_dir):
    return Clinic(spark, sf_dir).enhanced


@register("update_features", "SELECT * FROM features")
def q_update_features(spark, sf_dir):
    return Clinic(spark, sf_dir).features


@register("semi_valid_subjects", """
SELECT seq, hadm_id, subject_id FROM admissions_raw WHERE subject_id IN (SELECT subject_id FROM patients)""")
def q_semi_valid_subjects(spark, sf_dir):
    from carepath.operators.clean import semi_valid_subjects
    c = Clinic(spark, sf_dir)
    return semi_valid_subjects(c.admissions_raw, c.patients).select("seq", "hadm_id", "subject_id")


@register("semi_valid_notes", "SELECT seq, note_id, subject_id, hadm_id FROM notes_valid")
def q_semi_valid_notes(spark, sf_dir):
    from carepath.operators.clean import semi_valid_notes
    c = Clinic(spark, sf_dir)
    return semi_valid_notes(c.notes_raw, c.patients, c.admissions).select("seq", "note_id", "subject_id", "hadm_id")
