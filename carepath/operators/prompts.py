"""Prompt tables: one ready-to-send text per patient or question.

Templates are filled with ``format_string`` over pre-formatted columns, so a
whole table of prompts is one projection. Driver lines are assembled from at
most one row per model feature per patient (a bounded group).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.functions import scalar as X
from carepath.operators import serve

# Prompt templates, verbatim; {name} marks a filled-in field.
RISK_PROMPT = """You are a clinical decision support assistant.

PATIENT DATA:
  Patient ID     : {subject_id}
  Risk Score     : {risk_pct}
  Risk Tier      : {risk_tier}
  Admissions     : {admission_count}
  Emergency Ratio: {emergency_pct}
  Avg Stay (days): {avg_stay}
  Days Since Last: {days_since}

TOP RISK DRIVERS:
{driver_lines}

Write a clear 3-sentence clinical explanation for a doctor.
Use the actual numbers. Do not invent information."""

RISK_PROMPT_CLI = """You are a clinical decision support assistant helping doctors understand patient risk.

PATIENT DATA:
  Patient ID     : {subject_id}
  Risk Score     : {risk_pct}
  Risk Tier      : {risk_tier}
  Admissions     : {admission_count}
  Emergency Ratio: {emergency_pct}
  Avg Stay (days): {avg_stay}
  Days Since Last Admission: {days_since} days

SHAP FEATURE CONTRIBUTIONS (what drove this prediction):
{driver_lines}

Write a clear 3-sentence clinical explanation of this patient's risk for a doctor.
Focus on the top SHAP drivers. Be specific with the numbers. Do not make up information."""

DISCHARGE_PROMPT = """You are a senior hospital physician creating a discharge planning note.

PATIENT SUMMARY:
  Patient ID       : {subject_id}
  Risk Score       : {risk_pct}
  Risk Tier        : {risk_tier}
  Assigned Ward    : {ward}
  Ward Description : {ward_context}
  Estimated Stay   : {los} days
  Key Risk Drivers : {top_drivers}
  Total Admissions : {admission_count}
  Emergency Rate   : {emergency_pct}

Write a clinical discharge planning narrative with:
1. Ward placement rationale (1 sentence)
2. Expected timeline to discharge (specific days)
3. Key milestones before discharge can occur (2-3 bullet points)
4. Readmission prevention recommendation (1 sentence)

Be specific with numbers. Use clinical language."""

RAG_PROMPT = """You are a clinical decision support assistant.

PATIENT ID: {subject_id}

CLINICAL NOTES:
{context}

QUESTION: {question}

Answer based only on the notes. Be concise and clinical.
If notes lack enough info, say so clearly."""

RAG_PROMPT_CLI = """You are a clinical assistant helping doctors review patient history.

PATIENT ID: {subject_id}

RELEVANT CLINICAL NOTES:
{context}

DOCTOR'S QUESTION: {question}

Answer based only on the notes provided. Be concise and clinical.
If the notes don't contain enough information, say so clearly."""

# Fixed value: the answer when a patient has no notes.
NO_NOTES_ANSWER = "No clinical notes found for this patient."

_FIELD = re.compile(r"\{(\w+)\}")


def template_fields(template: str) -> tuple[str, list[str]]:
    """'{a} x {b}' -> ('%s x %s', ['a', 'b'])."""
    return _FIELD.sub("%s", template.replace("%", "%%")), _FIELD.findall(template)


def fill(template: str, values: dict[str, Column]) -> Column:
    fmt, names = template_fields(template)
    return F.format_string(fmt, *[values[n].cast("string") for n in names])


def _py_str(c: Column) -> Column:
    """Python's str() of an optional value: None prints as 'None'."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def driver_lines(drivers: Column, style: str = "api") -> Column:
    """All ranked drivers of a row, one line each."""
    def line(x: Column) -> Column:
        name = X.driver_key(x["feature"])
        if style == "api":
            return F.format_string("  - %s: %s risk (impact=%s)", name, X.driver_direction(x["value"]),
                                   X.fmt_fixed(F.abs(x["value"]), 3))
        return F.format_string("  - %s: SHAP=%s (%s risk)", name, X.fmt_fixed(x["value"], 4, sign=True),
                               X.driver_direction(x["value"]))
    return F.array_join(F.transform(drivers, line), "\n")


def top_driver_text(drivers: Column, k: int = 3) -> Column:
    """'name (high|low impact)' for the k largest drivers of a row, comma separated."""
    return F.array_join(F.transform(F.slice(drivers, 1, k), lambda x: F.format_string(
        "%s (%s impact)", X.driver_key(x["feature"]), X.driver_direction(x["value"], "high", "low"))), ", ")


def with_drivers(profile: DataFrame, shap: DataFrame, how: str) -> DataFrame:
    """Profile rows with their ranked attributions in a column ``drivers`` (null without any)."""
    return profile.join(shap.select("subject_id", serve.ranked_drivers(shap).alias("drivers")), "subject_id", how)


def risk_text(style: str = "api") -> Column:
    """Risk explanation prompt of a row of ``with_drivers``."""
    return fill(RISK_PROMPT if style == "api" else RISK_PROMPT_CLI, {
        "subject_id": F.col("subject_id"),
        "risk_pct": X.fmt_percent("risk_score"),
        "risk_tier": _py_str(F.col("risk_tier")),
        "admission_count": F.col("admission_count"),
        "emergency_pct": X.fmt_percent("emergency_ratio"),
        "avg_stay": X.fmt_fixed("avg_los_days", 1),
        "days_since": X.fmt_fixed("days_since_last_admission", 0),
        "driver_lines": driver_lines(F.col("drivers"), style),
    })


def discharge_text() -> Column:
    """Discharge-planning prompt of a row of ``with_drivers``; missing ward/stay/score/drivers take defaults."""
    return fill(DISCHARGE_PROMPT, {
        "subject_id": F.col("subject_id"),
        "risk_pct": X.fmt_percent(F.coalesce("risk_score", F.lit(0.0))),
        "risk_tier": _py_str(F.col("risk_tier")),
        "ward": F.coalesce("predicted_ward", F.lit("General")),
        "ward_context": X.ward_context(F.coalesce("predicted_ward", F.lit("General"))),
        "los": X.fmt_fixed(F.coalesce("estimated_los_days", F.lit(3.0)), 1),
        "top_drivers": F.coalesce(top_driver_text(F.col("drivers")), F.lit("")),
        "admission_count": F.col("admission_count"),
        "emergency_pct": X.fmt_percent("emergency_ratio"),
    })


def prompt_risk(profile: DataFrame, shap: DataFrame, style: str = "api") -> DataFrame:
    """Risk explanation prompt per patient that has attributions."""
    return with_drivers(profile, shap, "inner").select("subject_id", risk_text(style).alias("prompt"))


def prompt_discharge(profile: DataFrame, shap: DataFrame) -> DataFrame:
    """Discharge-planning prompt per patient."""
    return with_drivers(profile, shap, "left").select("subject_id", discharge_text().alias("prompt"))


def patient_report(profile: DataFrame, shap: DataFrame) -> DataFrame:
    """One nested row per scored patient: summary and driver entries, both prompts.

    Profile and attributions meet in one join; everything else is computed in the row.
    """
    j = with_drivers(profile, shap, "left")
    return j.select("subject_id", serve.report_summary().alias("summary"),
                    F.coalesce(serve.report_drivers(F.col("drivers")), F.array()).alias("drivers"),
                    F.when(F.col("drivers").isNotNull(), risk_text()).alias("explanation_prompt"),
                    discharge_text().alias("discharge_prompt"))


def prompt_rag(context: DataFrame, style: str = "api") -> DataFrame:
    """(question_id, subject_id, question, context) -> prompt."""
    vals = {"subject_id": F.col("subject_id"), "context": F.col("context"), "question": F.col("question")}
    return context.select("question_id", "subject_id",
                          fill(RAG_PROMPT if style == "api" else RAG_PROMPT_CLI, vals).alias("prompt"))
