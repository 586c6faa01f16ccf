"""The end-to-end batch job: load -> features -> train -> score -> wards.

Each stage reads the tables the previous one wrote and writes its own under
``root`` (a shared folder). Stages are DataFrame -> DataFrame functions; ids
never leave the cluster, and each stage is one write.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath import schemas as S
from carepath.operators import clean, features as FE, ml as ML, shap as SH
from carepath.sources.tables import (check_unique_key, evolve_columns, load_summary, update_by_key,
                                     write_version)


@dataclass
class RawInputs:
    patients: DataFrame
    admissions: DataFrame
    notes: DataFrame
    diagnoses: DataFrame
    icustays: DataFrame


def run_batch(spark: SparkSession, raw: RawInputs, root: str, as_of: str = FE.AS_OF,
              ward_labels: DataFrame | None = None, rounds_enhanced: int = 300, rounds_basic: int = 100,
              ward_rounds: int = 100, notes_limit: int | None = None) -> dict[str, str]:
    paths = {n: f"{root.rstrip('/')}/{n}" for n in
             ("patients", "admissions", "notes", "patient_features", "patient_risk_scores",
              "patient_shap_values", "risk_model", "enhanced_model", "ward_model", "training_report")}

    # ingest: patients -> admissions of known patients -> notes of known patients and admissions
    patients = write_version(clean.clean_patients(raw.patients), paths["patients"])
    admissions = write_version(clean.clean_admissions(raw.admissions, patients), paths["admissions"])
    write_version(clean.clean_notes(raw.notes, patients, admissions, notes_limit), paths["notes"])

    # features: base statistics, migrated columns, enrichment by key
    base = FE.patient_features(patients, admissions, as_of)
    enhanced = FE.enhanced_features(spark, raw.patients, raw.admissions, raw.diagnoses, raw.icustays)
    feats = update_by_key(evolve_columns(base, S.ADDED_FEATURE_TYPES), enhanced, "subject_id", S.ADDED_FEATURES)
    feats = write_version(feats, paths["patient_features"])

    # enhanced model: hold-out evaluation and gate, saved for reuse
    enh = ML.training_frame(feats, S.ENHANCED_FEATURES, recency_default=0.0)
    cols = ML.kept_features(enh, S.ENHANCED_FEATURES)
    split = ML.class_weights(ML.stratified_split(enh).checkpoint(eager=True), mode="pos_scale")
    enh_model = ML.train_gbt_enhanced(split.filter("split = 'train'"), cols, rounds=rounds_enhanced)
    ML.save_model(enh_model, paths["enhanced_model"])
    held = ML.score(enh_model, split.filter("split = 'test'"))
    report = ML.classification_report(held, prediction="risk_prediction") \
               .withColumn("roc_auc", F.lit(ML.roc_auc(held).first()["roc_auc"]))
    write_version(report, paths["training_report"])

    # risk scores and attributions for every labelled patient (basic model on all rows)
    basic = ML.class_weights(ML.training_frame(feats, S.BASIC_FEATURES), mode="pos_scale")
    model = ML.train_gbt_base(basic, rounds=rounds_basic)
    ML.save_model(model, paths["risk_model"])
    scores = ML.score(model, basic).select("subject_id", "risk_score", "risk_prediction", "risk_tier")
    scores = evolve_columns(scores, S.ADDED_SCORE_TYPES, default=None)
    scores = write_version(scores, paths["patient_risk_scores"])
    shap = SH.shap_values(spark, basic, S.BASIC_FEATURES, SH.gbt_stage_path(paths["risk_model"], spark))
    write_version(shap.drop("base_value"), paths["patient_shap_values"])

    # wards: train on labelled rows, predict for all, update the score table by key
    if ward_labels is not None:
        f = feats.select("subject_id", *[F.col(c).cast("double") for c in
                                         ("admission_count", "emergency_ratio", "avg_los_days", "max_los_days")],
                         F.coalesce("days_since_last_admission", F.lit(-1.0)).alias("days_since_last_admission"),
                         F.col("has_previous_admission").cast("double"))
        data = f.join(scores.select("subject_id", "risk_score"), "subject_id") \
                .join(ward_labels.select("subject_id", "predicted_ward"), "subject_id", "left")
        wmodel = ML.train_ward(data.filter(F.col("predicted_ward").isNotNull()), rounds=ward_rounds)
        ML.save_model(wmodel, paths["ward_model"])
        wards = ML.score_ward(wmodel, data).select("subject_id", F.col("ward_pred").alias("predicted_ward"))
        scores = write_version(update_by_key(scores, wards, "subject_id", ["predicted_ward"]),
                               paths["patient_risk_scores"] + "_v2")
        paths["patient_risk_scores"] += "_v2"

    bad = check_unique_key(spark.read.parquet(paths["patient_risk_scores"]), "subject_id").limit(1).count()
    if bad:
        raise ValueError("patient_risk_scores has duplicate or null keys")
    paths["summary"] = root.rstrip("/") + "/load_summary"
    write_version(load_summary({n: spark.read.parquet(paths[n]) for n in
                                ("patients", "admissions", "notes", "patient_features")}), paths["summary"])
    return paths
