"""The clinical tables of one data directory, built lazily as DataFrames.

Nothing here runs a job: each property is a logical plan, and every query
that uses it gets Catalyst's view of the whole chain (pruning, pushdown,
exchange reuse). Tables a query reads more than once are shared objects,
so identical shuffles inside one plan are reused.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath import schemas as S
from carepath.functions import scalar as X
from carepath.operators import clean, features
from carepath.sources import fixtures as FX
from carepath.session import ensure_checkpoint_dir
from carepath.sources.tables import evolve_columns, update_by_key


class Clinic:
    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = features.AS_OF,
                 notes_limit: int | None = None):
        self.spark, self.sf_dir, self.as_of, self.notes_limit = spark, sf_dir, as_of, notes_limit
        ensure_checkpoint_dir(spark)

    # raw exports
    @cached_property
    def patients_raw(self) -> DataFrame:
        return FX.patients_raw(self.spark, self.sf_dir)

    @cached_property
    def admissions_raw(self) -> DataFrame:
        return FX.admissions_raw(self.spark, self.sf_dir)

    @cached_property
    def diagnoses_raw(self) -> DataFrame:
        return FX.diagnoses_raw(self.spark, self.sf_dir)

    @cached_property
    def icustays_raw(self) -> DataFrame:
        return FX.icustays_raw(self.spark, self.sf_dir)

    @cached_property
    def notes_raw(self) -> DataFrame:
        return FX.notes_raw(self.spark, self.sf_dir)

    # cleaned tables
    @cached_property
    def patients(self) -> DataFrame:
        return clean.clean_patients(self.patients_raw)

    @cached_property
    def admissions(self) -> DataFrame:
        return clean.clean_admissions(self.admissions_raw, self.patients)

    @cached_property
    def notes(self) -> DataFrame:
        return clean.clean_notes(self.notes_raw, self.patients, self.admissions, self.notes_limit)

    # features
    @cached_property
    def base_features(self) -> DataFrame:
        return features.patient_features(self.patients, self.admissions, self.as_of)

    @cached_property
    def enhanced(self) -> DataFrame:
        return features.enhanced_features(self.spark, self.patients_raw, self.admissions_raw,
                                          self.diagnoses_raw, self.icustays_raw)

    @cached_property
    def features(self) -> DataFrame:
        """patient_features after migration (added columns = 0) and enrichment."""
        migrated = evolve_columns(self.base_features, S.ADDED_FEATURE_TYPES, default=0)
        return update_by_key(migrated, self.enhanced, "subject_id", S.ADDED_FEATURES)

    # score-side fixtures (model outputs stand-ins for serving queries)
    @cached_property
    def risk_fixture(self) -> DataFrame:
        return FX.risk_scores(self.spark, self.sf_dir)

    @cached_property
    def scores(self) -> DataFrame:
        """patient_risk_scores in its migrated shape, from the score fixture."""
        r = self.risk_fixture
        return r.select("subject_id", "risk_score",
                        X.flag(F.col("risk_score") > 0.5).alias("risk_prediction"),
                        X.risk_tier("risk_score").alias("risk_tier"),
                        "predicted_ward",
                        F.lit(None).cast("double").alias("estimated_los_days"))

    @cached_property
    def shap_fixture(self) -> DataFrame:
        return FX.shap_values(self.spark, self.sf_dir)

    @cached_property
    def note_vectors(self) -> DataFrame:
        return FX.note_vectors(self.spark, self.sf_dir)

    @cached_property
    def questions(self) -> DataFrame:
        return FX.questions_raw(self.spark, self.sf_dir)
