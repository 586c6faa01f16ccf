"""Sources, sinks, table maintenance, scalar expressions, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from carepath import schemas as S
from carepath.functions import scalar as X
from carepath.operators import clean
from carepath.operators import features as FE
from carepath.plans.catalog import register
from carepath.plans.context import Clinic
from carepath.session import shared_path
from carepath.sources import files, tables
from carepath.sources.keyed import KeyedTable

NOTE_COLS = "seq, note_id, subject_id, hadm_id, charttime, category, text"

# ------------------------------------------------------------------ A: I/O


@register("scan_csv", f"SELECT {NOTE_COLS} FROM notes_raw")
def q_scan_csv(spark, sf_dir):
    """Notes export written as gzip CSV (multi-line quoted text), read back typed."""
    c = Clinic(spark, sf_dir)
    base = shared_path(spark, "noteevents")
    files.write_csv(c.notes_raw, f"{base}/NOTEEVENTS.csv.gz", compression="gzip", upper_headers=True)
    schema = S.T.StructType([S.T.StructField("seq", S.T.LongType()),
                             S.T.StructField("note_id", S.T.LongType())] + S.NOTES_RAW.fields)
    return files.scan_csv(spark, files.resolve_csv(spark, base, "NOTEEVENTS.csv.gz"), schema, multi_line=True)


@register("scan_csv_order", """
SELECT row_number() OVER (ORDER BY subject_id, seq) - 1 AS place, subject_id, gender, dob FROM patients_raw""")
def q_scan_csv_order(spark, sf_dir):
    """A sorted export in several files, read back with the gapless place of every row in them."""
    c = Clinic(spark, sf_dir)
    path = f"{shared_path(spark, 'patients_export')}/PATIENTS.csv"
    files.write_csv(c.patients_raw.orderBy("subject_id", "seq"), path, upper_headers=True)
    return files.scan_csv(spark, path, S.PATIENTS_RAW, order="place").select("place", "subject_id", "gender", "dob")


@register("require_inputs", """
SELECT 'patients' AS table_name, COUNT(*) AS n_rows FROM patients_raw
UNION ALL SELECT 'admissions', COUNT(*) FROM admissions_raw
UNION ALL SELECT 'notes', COUNT(*) FROM notes_raw
UNION ALL SELECT 'icustays', 0""")
def q_require_inputs(spark, sf_dir):
    """Required exports resolve (.csv.gz, or .csv fallback); the optional one is empty."""
    c = Clinic(spark, sf_dir)
    base = shared_path(spark, "exports")
    files.write_csv(c.patients_raw, f"{base}/PATIENTS.csv.gz", compression="gzip", upper_headers=True)
    files.write_csv(c.admissions_raw, f"{base}/ADMISSIONS.csv", upper_headers=True)
    files.write_csv(c.notes_raw, f"{base}/NOTEEVENTS.csv.gz", compression="gzip", upper_headers=True)
    found = files.require_inputs(spark, base, ["PATIENTS.csv.gz", "ADMISSIONS.csv.gz", "NOTEEVENTS.csv.gz"])
    notes = files.scan_csv(spark, found["NOTEEVENTS.csv.gz"], S.NOTES_RAW, multi_line=True)
    pats = files.scan_csv(spark, found["PATIENTS.csv.gz"], S.PATIENTS_RAW)
    adms = files.scan_csv(spark, found["ADMISSIONS.csv.gz"], S.ADMISSIONS_RAW)
    icu = files.load_optional(spark, base, "ICUSTAYS.csv.gz", S.ICUSTAYS_RAW)
    return tables.load_summary({"patients": pats, "admissions": adms, "notes": notes, "icustays": icu})


@register("lower_columns", "SELECT seq, subject_id, gender, dob FROM patients_raw")
def q_lower_columns(spark, sf_dir):
    raw = Clinic(spark, sf_dir).patients_raw
    upper = raw.toDF(*[col.upper() for col in raw.columns])
    return files.lower_columns(upper)


@register("read_table", """
SELECT admission_count, emergency_ratio, COALESCE(days_since_last_admission, -1) AS days_since_last_admission,
       has_previous_admission, high_risk_label
FROM patient_features WHERE high_risk_label IS NOT NULL""")
def q_read_table(spark, sf_dir):
    """Stored feature table read through a named-parameter query."""
    path = shared_path(spark, "patient_features")
    tables.replace_table(Clinic(spark, sf_dir).base_features, path)
    return files.read_table(spark, path, """
        SELECT admission_count, emergency_ratio,
               COALESCE(days_since_last_admission, :missing) AS days_since_last_admission,
               has_previous_admission, high_risk_label
        FROM {t} WHERE high_risk_label IS NOT NULL""", args={"missing": -1.0})


@register("append_table", "SELECT subject_id, gender, dob FROM patients")
def q_append_table(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    path = shared_path(spark, "patients")
    tables.append_table(c.patients.where("subject_id % 2 = 0"), path)
    tables.append_table(c.patients.where("subject_id % 2 <> 0"), path)      # to a table that has rows
    return spark.read.parquet(path)


@register("replace_table", f"SELECT {', '.join(['subject_id'] + S.BASE_FEATURES)} FROM patient_features")
def q_replace_table(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    path = shared_path(spark, "features")
    tables.replace_table(c.enhanced, path)           # an older, different table
    tables.replace_table(c.base_features, path)      # replaced whole
    return spark.read.parquet(path)


@register("clear_tables", "SELECT subject_id, gender, dob FROM patients")
def q_clear_tables(spark, sf_dir):
    """Reload after clearing all six tables, children first: no stale rows survive."""
    c = Clinic(spark, sf_dir)
    root = shared_path(spark, "db")
    # delete order: what refers to a table goes before it
    held = {"patient_shap_values": c.shap_fixture, "patient_risk_scores": c.scores, "patient_features": c.base_features,
            "notes": c.notes, "admissions": c.admissions, "patients": c.patients}
    for name, df in held.items():
        tables.replace_table(df, f"{root}/{name}")
    tables.clear_tables(spark, {name: (f"{root}/{name}", df.schema) for name, df in held.items()})
    stored = {name: spark.read.schema(df.schema).parquet(f"{root}/{name}") for name, df in held.items()}
    stale = [r.table_name for r in tables.load_summary(stored).where("n_rows > 0").collect()]
    if stale:
        raise ValueError(f"rows left after clearing: {stale}")
    tables.append_table(c.patients, f"{root}/patients")
    return spark.read.parquet(f"{root}/patients")


_OLD_FEATURES = """
old_stays AS (SELECT * FROM stays WHERE admittime < TIMESTAMP '1998-01-01 00:00:00'),
old_base AS (
  SELECT subject_id, COUNT(hadm_id) AS admission_count,
         CAST(SUM(stay_us) AS DOUBLE) / COUNT(*) / CAST(86400000000 AS DOUBLE) AS avg_los_days,
         MAX(stay_us) / CAST(86400000000 AS DOUBLE) AS max_los_days,
         CAST(SUM(CASE WHEN admission_type = 'EMERGENCY' THEN 1 ELSE 0 END) AS DOUBLE)
           / CAST(NULLIF(COUNT(hadm_id), 0) AS DOUBLE) AS emergency_ratio,
         (epoch_us(TIMESTAMP '2002-01-01 00:00:00') - epoch_us(MAX(admittime))) / CAST(86400000000 AS DOUBLE)
           AS days_since_last_admission,
         CASE WHEN COUNT(hadm_id) > 1 THEN 1 ELSE 0 END AS has_previous_admission,
         CASE WHEN SUM(stay_us) > COUNT(*) * CAST(561600000000 AS BIGINT) THEN 1 ELSE 0 END AS high_risk_label
  FROM old_stays GROUP BY subject_id),
old_features AS (
  SELECT o.*, COALESCE(e.age, CAST(0 AS DOUBLE)) AS age, COALESCE(e.gender_male, 0) AS gender_male,
         COALESCE(e.charlson_score, CAST(0 AS DOUBLE)) AS charlson_score,
         COALESCE(e.num_diagnoses, 0) AS num_diagnoses, COALESCE(e.num_icu_stays, 0) AS num_icu_stays,
         COALESCE(e.total_icu_hours, CAST(0 AS DOUBLE)) AS total_icu_hours, COALESCE(e.had_icu, 0) AS had_icu
  FROM old_base o LEFT JOIN enhanced e ON o.subject_id = e.subject_id)"""


@register("upsert_features", "," + _OLD_FEATURES + """
SELECT COALESCE(n.subject_id, o.subject_id) AS subject_id,
       CASE WHEN n.subject_id IS NOT NULL THEN n.admission_count ELSE o.admission_count END AS admission_count,
       CASE WHEN n.subject_id IS NOT NULL THEN n.avg_los_days ELSE o.avg_los_days END AS avg_los_days,
       CASE WHEN n.subject_id IS NOT NULL THEN n.max_los_days ELSE o.max_los_days END AS max_los_days,
       CASE WHEN n.subject_id IS NOT NULL THEN n.emergency_ratio ELSE o.emergency_ratio END AS emergency_ratio,
       CASE WHEN n.subject_id IS NOT NULL THEN n.days_since_last_admission ELSE o.days_since_last_admission END
         AS days_since_last_admission,
       CASE WHEN n.subject_id IS NOT NULL THEN n.has_previous_admission ELSE o.has_previous_admission END
         AS has_previous_admission,
       CASE WHEN n.subject_id IS NOT NULL THEN n.high_risk_label ELSE o.high_risk_label END AS high_risk_label,
       COALESCE(o.age, 0) AS age, COALESCE(o.gender_male, 0) AS gender_male,
       COALESCE(o.charlson_score, 0) AS charlson_score, COALESCE(o.num_diagnoses, 0) AS num_diagnoses,
       COALESCE(o.num_icu_stays, 0) AS num_icu_stays, COALESCE(o.total_icu_hours, 0) AS total_icu_hours,
       COALESCE(o.had_icu, 0) AS had_icu
FROM old_features o FULL OUTER JOIN patient_features n ON o.subject_id = n.subject_id""")
def q_upsert_features(spark, sf_dir):
    """Yesterday's enriched table (stays before 1998) upserted with today's base features."""
    c = Clinic(spark, sf_dir)
    old_adm = c.admissions.filter(F.col("admittime") < X.ts_literal("1998-01-01 00:00:00"))
    old = tables.update_by_key(
        tables.evolve_columns(FE.patient_features(c.patients, old_adm, c.as_of), S.ADDED_FEATURE_TYPES),
        c.enhanced, "subject_id", S.ADDED_FEATURES)
    return tables.upsert(old, c.base_features, "subject_id", S.BASE_FEATURES,
                         defaults={k: 0 for k in S.ADDED_FEATURES})


@register("update_ward", """
SELECT s.subject_id, s.risk_score, s.risk_prediction, s.risk_tier,
       COALESCE(w.predicted_ward, s.predicted_ward) AS predicted_ward, s.estimated_los_days
FROM (SELECT subject_id, risk_score, risk_prediction, risk_tier, CAST(NULL AS VARCHAR) AS predicted_ward,
             estimated_los_days FROM scores) s
LEFT JOIN (SELECT subject_id, predicted_ward FROM risk_fixture WHERE predicted_ward IS NOT NULL) w
  ON s.subject_id = w.subject_id""")
def q_update_ward(spark, sf_dir):
    """Ward predictions written into the score table by key (no row loop)."""
    c = Clinic(spark, sf_dir)
    table = c.scores.withColumn("predicted_ward", F.lit(None).cast("string"))
    wards = c.risk_fixture.filter(F.col("predicted_ward").isNotNull()).select("subject_id", "predicted_ward")
    return tables.update_by_key(table, wards, "subject_id", ["predicted_ward"])


@register("update_table", """
SELECT s.subject_id, s.risk_score, s.risk_tier,
       CASE WHEN s.subject_id % 97 = 5 THEN 'Private' WHEN s.risk_score > 0.9 THEN 'ICU' ELSE s.predicted_ward END AS predicted_ward
FROM scores s""")
def q_update_table(spark, sf_dir):
    """Two keyed updates of a stored score table; each rewrites only the buckets that hold a changed key."""
    scores = Clinic(spark, sf_dir).scores.select("subject_id", "risk_score", "risk_tier", "predicted_ward")
    stored = KeyedTable.create(scores, shared_path(spark, "scores_by_key"), "subject_id")
    ward = lambda rows, name: rows.select("subject_id", F.lit(name).alias("predicted_ward"))
    stored.update(ward(scores.where("risk_score > 0.9"), "ICU"), ["predicted_ward"])
    stored.update(ward(scores.where("subject_id % 97 = 5"), "Private"), ["predicted_ward"])
    return stored.read()


@register("evolve_columns", """
SELECT *, CAST(0 AS DOUBLE) AS age, 0 AS gender_male, CAST(0 AS DOUBLE) AS charlson_score, 0 AS num_diagnoses,
       0 AS num_icu_stays, CAST(0 AS DOUBLE) AS total_icu_hours, 0 AS had_icu
FROM patient_features""")
def q_evolve_columns(spark, sf_dir):
    once = tables.evolve_columns(Clinic(spark, sf_dir).base_features, S.ADDED_FEATURE_TYPES)
    return tables.evolve_columns(once, S.ADDED_FEATURE_TYPES)    # idempotent


@register("check_unique_key", """
SELECT subject_id, COUNT(*) AS n_rows FROM patients_raw GROUP BY subject_id
HAVING COUNT(*) > 1 OR subject_id IS NULL""")
def q_check_unique_key(spark, sf_dir):
    return tables.check_unique_key(Clinic(spark, sf_dir).patients_raw, "subject_id")


@register("load_summary", """
SELECT 'patients' AS table_name, COUNT(*) AS n_rows FROM patients
UNION ALL SELECT 'admissions', COUNT(*) FROM admissions
UNION ALL SELECT 'notes', COUNT(*) FROM notes
UNION ALL SELECT 'patient_features', COUNT(*) FROM patient_features""")
def q_load_summary(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    return tables.load_summary({"patients": c.patients, "admissions": c.admissions,
                                "notes": c.notes, "patient_features": c.base_features})


# --------------------------------------------------- B: projections, scalars


@register("project_patients", "SELECT subject_id, gender, TRY_CAST(dob AS DATE) AS dob, seq FROM patients_raw")
def q_project_patients(spark, sf_dir):
    return clean.project_patients(Clinic(spark, sf_dir).patients_raw)


@register("project_admissions", """
SELECT seq, hadm_id, subject_id, TRY_CAST(admittime AS TIMESTAMP) AS admittime,
       TRY_CAST(dischtime AS TIMESTAMP) AS dischtime, admission_type FROM admissions_raw""")
def q_project_admissions(spark, sf_dir):
    return clean.project_admissions(Clinic(spark, sf_dir).admissions_raw)


@register("project_notes", f"""
SELECT seq, note_id, subject_id, hadm_id, TRY_CAST(charttime AS TIMESTAMP) AS charttime, category, text
FROM notes_raw""")
def q_project_notes(spark, sf_dir):
    return clean.project_notes(Clinic(spark, sf_dir).notes_raw)


@register("safe_parse_date", "SELECT seq, subject_id, dob AS dob_text, TRY_CAST(dob AS DATE) AS dob FROM patients_raw")
def q_safe_parse_date(spark, sf_dir):
    r = Clinic(spark, sf_dir).patients_raw
    return r.select("seq", "subject_id", F.col("dob").alias("dob_text"), X.safe_parse_date("dob").alias("dob"))


@register("safe_parse_ts", """
SELECT seq, hadm_id, dischtime AS dischtime_text, TRY_CAST(dischtime AS TIMESTAMP) AS dischtime FROM admissions_raw""")
def q_safe_parse_ts(spark, sf_dir):
    r = Clinic(spark, sf_dir).admissions_raw
    return r.select("seq", "hadm_id", F.col("dischtime").alias("dischtime_text"),
                    X.safe_parse_ts("dischtime").alias("dischtime"))


@register("default_category", """
SELECT note_id, 'Unknown' AS category FROM notes_raw""")
def q_default_category(spark, sf_dir):
    raw = Clinic(spark, sf_dir).notes_raw.drop("category")     # export without the column
    return clean.project_notes(raw).select("note_id", "category")


@register("stay_days", """
SELECT hadm_id, (epoch_us(dischtime) - epoch_us(admittime)) / CAST(86400000000 AS DOUBLE) AS stay_days
FROM admissions""")
def q_stay_days(spark, sf_dir):
    return Clinic(spark, sf_dir).admissions.select("hadm_id", X.stay_days().alias("stay_days"))


@register("days_since_last", """
SELECT subject_id, (epoch_us(TIMESTAMP '2002-01-01 00:00:00') - epoch_us(MAX(admittime))) / CAST(86400000000 AS DOUBLE)
       AS days_since_last_admission
FROM admissions GROUP BY subject_id""")
def q_days_since_last(spark, sf_dir):
    a = Clinic(spark, sf_dir).admissions
    return (a.groupBy("subject_id").agg(F.max("admittime").alias("last"))
             .select("subject_id", X.days_since("last", FE.AS_OF).alias("days_since_last_admission")))


@register("safe_ratio", """
SELECT p.subject_id,
       CAST(SUM(CASE WHEN a.admission_type = 'EMERGENCY' THEN 1 ELSE 0 END) AS DOUBLE)
         / CAST(NULLIF(COUNT(a.hadm_id), 0) AS DOUBLE) AS emergency_ratio
FROM patients p LEFT JOIN admissions a ON p.subject_id = a.subject_id GROUP BY p.subject_id""")
def q_safe_ratio(spark, sf_dir):
    """Ratio over every patient: no admissions gives null, not an error."""
    c = Clinic(spark, sf_dir)
    st = (c.admissions.groupBy("subject_id")
          .agg(F.count("hadm_id").alias("n"),
               F.sum(X.flag(F.col("admission_type") == "EMERGENCY")).alias("e")))
    j = c.patients.select("subject_id").join(st, "subject_id", "left")
    return j.select("subject_id", X.safe_ratio(F.coalesce("e", F.lit(0)), F.coalesce("n", F.lit(0)))
                    .alias("emergency_ratio"))


@register("flag_previous", "SELECT subject_id, has_previous_admission FROM patient_features")
def q_flag_previous(spark, sf_dir):
    return Clinic(spark, sf_dir).base_features.select("subject_id", "has_previous_admission")


@register("label_high_risk", "SELECT subject_id, high_risk_label FROM patient_features")
def q_label_high_risk(spark, sf_dir):
    return Clinic(spark, sf_dir).base_features.select("subject_id", "high_risk_label")


@register("age_at_first_admit", "SELECT subject_id, seq, age FROM age_rows")
def q_age_at_first_admit(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    pat = clean.project_patients(c.patients_raw)
    return (pat.join(FE.first_admission(c.admissions_raw), "subject_id", "left")
               .select("subject_id", "seq", X.age_years("first_admit", "dob").alias("age")))


@register("encode_gender", """
SELECT seq, subject_id, gender, CASE WHEN gender = 'M' THEN 1 ELSE 0 END AS gender_male FROM patients_raw""")
def q_encode_gender(spark, sf_dir):
    r = Clinic(spark, sf_dir).patients_raw
    return r.select("seq", "subject_id", "gender", X.encode_gender("gender").alias("gender_male"))


@register("had_icu_flag", "SELECT subject_id, had_icu FROM enhanced")
def q_had_icu_flag(spark, sf_dir):
    return Clinic(spark, sf_dir).enhanced.select("subject_id", "had_icu")


@register("clean_code", "SELECT DISTINCT subject_id, icd9_code, regexp_replace(icd9_code, '^[[:space:]]+|[[:space:]]+$', '', 'g') AS code FROM diag_codes")
def q_clean_code(spark, sf_dir):
    codes = FE.diagnosis_codes(Clinic(spark, sf_dir).diagnoses_raw)
    return codes.select("subject_id", "icd9_code", X.clean_code("icd9_code").alias("code"))


@register("default_recency", """
SELECT p.subject_id, COALESCE(f.days_since_last_admission, -1) AS days_since_last_admission
FROM patients p LEFT JOIN patient_features f ON p.subject_id = f.subject_id""")
def q_default_recency(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    j = c.patients.select("subject_id").join(c.base_features, "subject_id", "left")
    return j.select("subject_id", X.default_recency().alias("days_since_last_admission"))


@register("default_zero", """
SELECT p.subject_id, COALESCE(f.age, 0) AS age, COALESCE(f.gender_male, 0) AS gender_male,
       COALESCE(f.charlson_score, 0) AS charlson_score, COALESCE(f.num_diagnoses, 0) AS num_diagnoses,
       COALESCE(f.num_icu_stays, 0) AS num_icu_stays, COALESCE(f.total_icu_hours, 0) AS total_icu_hours,
       COALESCE(f.had_icu, 0) AS had_icu
FROM patients p LEFT JOIN features f ON p.subject_id = f.subject_id""")
def q_default_zero(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    j = c.patients.select("subject_id").join(c.features, "subject_id", "left")
    return j.select("subject_id", *[X.default_zero(k).cast(S.ADDED_FEATURE_TYPES[k]).alias(k)
                                    for k in S.ADDED_FEATURES])


# ------------------------------------------------------------- C: filters


@register("filter_complete_stays", "SELECT hadm_id FROM admissions WHERE admittime IS NOT NULL AND dischtime IS NOT NULL")
def q_filter_complete_stays(spark, sf_dir):
    return FE.filter_complete_stays(Clinic(spark, sf_dir).admissions).select("hadm_id")


@register("filter_labelled", """
SELECT s.subject_id, s.predicted_ward FROM scores s JOIN patient_features f ON s.subject_id = f.subject_id
WHERE s.predicted_ward IS NOT NULL AND f.high_risk_label IS NOT NULL""")
def q_filter_labelled(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    f = c.base_features.filter(F.col("high_risk_label").isNotNull()).select("subject_id")
    s = c.scores.filter(F.col("predicted_ward").isNotNull()).select("subject_id", "predicted_ward")
    return s.join(f, "subject_id")


@register("drop_null_text", "SELECT note_id FROM notes")
def q_drop_null_text(spark, sf_dir):
    return Clinic(spark, sf_dir).notes.select("note_id")


@register("drop_incomplete_age", "SELECT subject_id, seq, age FROM age_rows WHERE age IS NOT NULL")
def q_drop_incomplete_age(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    pat = clean.project_patients(c.patients_raw)
    rows = (pat.join(FE.first_admission(c.admissions_raw), "subject_id", "left")
               .select("subject_id", "seq", X.age_years("first_admit", "dob").alias("age"),
                       X.encode_gender("gender").alias("gender_male")))
    return rows.dropna(subset=["subject_id", "age", "gender_male"]).select("subject_id", "seq", "age")


@register("question_nonempty", "SELECT question_id, subject_id FROM questions_raw WHERE regexp_matches(question, '[^[:space:]]')")
def q_question_nonempty(spark, sf_dir):
    from carepath.functions.predicates import question_nonempty
    return question_nonempty(Clinic(spark, sf_dir).questions).select("question_id", "subject_id")
