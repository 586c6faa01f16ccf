"""The whole batch job on the smallest tables: every stage writes a consistent table."""

import pytest

from carepath import schemas as S
from carepath import session
from carepath.operators import clean, features
from carepath.plans.batch import RawInputs, run_batch
from carepath.plans.context import Clinic
from carepath.session import shared_path
from carepath.sources import files
from conftest import SF_SMALL


def test_batch_end_to_end(spark):
    c = Clinic(spark, SF_SMALL)
    raw = RawInputs(c.patients_raw, c.admissions_raw, c.notes_raw, c.diagnoses_raw, c.icustays_raw)
    paths = run_batch(spark, raw, shared_path(spark, "warehouse"), ward_labels=c.risk_fixture,
                      rounds_enhanced=5, rounds_basic=5, ward_rounds=5)
    feats = spark.read.parquet(paths["patient_features"])
    scores = spark.read.parquet(paths["patient_risk_scores"])
    shap = spark.read.parquet(paths["patient_shap_values"])
    assert feats.count() == c.features.count()
    assert scores.count() == shap.count() == feats.filter("high_risk_label IS NOT NULL").count()
    assert scores.filter("predicted_ward IS NULL").count() == 0
    assert set(scores.columns) >= {"risk_score", "risk_tier", "predicted_ward", "estimated_los_days"}
    assert spark.read.parquet(paths["training_report"]).count() >= 3


def test_ingest_from_csv_exports(spark):
    """The five exports as files, without any row-order or note column, give the cleaned tables."""
    c = Clinic(spark, SF_SMALL)
    base = shared_path(spark, "exports")
    for name, df in (("PATIENTS", c.patients_raw), ("ADMISSIONS", c.admissions_raw), ("NOTEEVENTS", c.notes_raw),
                     ("DIAGNOSES_ICD", c.diagnoses_raw), ("ICUSTAYS", c.icustays_raw)):
        ordered = df.orderBy("seq").coalesce(1) if "seq" in df.columns else df
        files.write_csv(ordered.drop("seq", "note_id"), f"{base}/{name}.csv.gz", compression="gzip", upper_headers=True)
    found = files.require_inputs(spark, base, ["PATIENTS", "ADMISSIONS", "NOTEEVENTS"])
    pats = files.scan_csv(spark, found["PATIENTS"], S.PATIENTS_RAW, order="seq")
    adms = files.scan_csv(spark, found["ADMISSIONS"], S.ADMISSIONS_RAW, order="seq")
    notes = files.scan_csv(spark, found["NOTEEVENTS"], S.NOTES_RAW, multi_line=True, order="seq")
    patients = clean.clean_patients(pats)
    admissions = clean.clean_admissions(adms, patients)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(patients) == rows(c.patients)
    assert rows(admissions) == rows(c.admissions)
    columns = ["subject_id", "hadm_id", "charttime", "category", "text"]
    loaded = clean.clean_notes(notes, patients, admissions)
    assert rows(loaded.select(*columns)) == rows(c.notes.select(*columns))
    assert loaded.select("note_id").distinct().count() == loaded.count()


def test_missing_export_is_named(spark):
    base = shared_path(spark, "exports")
    files.write_csv(spark.range(1), f"{base}/PATIENTS.csv")
    with pytest.raises(files.MissingInput, match="NOTEEVENTS"):
        files.require_inputs(spark, base, ["PATIENTS", "NOTEEVENTS"])


def test_first_rows_with_missing_order(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (None, "d")], "seq long, x string")
    assert [sorted(r.x for r in clean.first_n_by(df, "seq", n).collect()) for n in (1, 2, 3, 4)] == [
        ["a"], ["a", "c"], ["a", "b", "c"], ["a", "b", "c", "d"]]


def test_codes_of_white_space_and_nulls(spark):
    raw = spark.createDataFrame([(1, "\t428 "), (2, None), (3, "428"), (3, None)], "subject_id long, icd9_code string")
    codes = features.diagnosis_codes(raw)
    assert {r.subject_id: r.num_diagnoses for r in features.num_diagnoses(codes).collect()} == {1: 1, 2: 0, 3: 1}
    score = features.charlson_score(codes, features.charlson_lookup(spark))
    assert {r.subject_id for r in score.collect()} == {1, 3}


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session)
