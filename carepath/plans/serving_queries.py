"""Score serving: tiers, counts, dashboard, lists, drivers, profiles, reports, prompts
(SURVEY §2 B16–B23, D1, D8, E6–E10, E14, E15, F, G, K, J8, J9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from carepath import schemas as S
from carepath.functions import scalar as X
from carepath.operators import prompts as P
from carepath.operators import serve as SV
from carepath.plans.catalog import register
from carepath.plans.context import Clinic
from carepath.plans.oracle import fill, fmt, fmt_browser, lit, pct
from carepath.session import shared_path
from carepath.sources.tables import write_lookup
from carepath.sources.versions import get_or_build, input_fingerprint

LIST_COLS = "subject_id, risk_score, risk_tier, admission_count, emergency_ratio"


def _profile(c: Clinic):
    return SV.patient_profile(c.scores, c.features)


@register("risk_tier", """
SELECT subject_id, risk_score, risk_tier FROM scores""")
def q_risk_tier(spark, sf_dir):
    return Clinic(spark, sf_dir).risk_fixture.select("subject_id", "risk_score",
                                                     X.risk_tier("risk_score").alias("risk_tier"))


@register("risk_band", """
SELECT subject_id, CASE WHEN risk_score >= 0.7 THEN 'HIGH' WHEN risk_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS band
FROM scores""")
def q_risk_band(spark, sf_dir):
    return Clinic(spark, sf_dir).scores.select("subject_id", X.risk_band("risk_score").alias("band"))


@register("score_bucket", "SELECT subject_id, CAST(least(floor(risk_score * 10), 9) AS INTEGER) AS bucket FROM scores")
def q_score_bucket(spark, sf_dir):
    return Clinic(spark, sf_dir).scores.select("subject_id", X.score_bucket("risk_score").alias("bucket"))


@register("format_percent", f"""
SELECT subject_id, {pct('risk_score')} AS risk_pct, {pct('emergency_ratio')} AS emergency_pct,
       {fmt('avg_los_days', 1)} AS avg_stay, {fmt('days_since_last_admission', 0)} AS days_since
FROM profile""")
def q_format_percent(spark, sf_dir):
    p = _profile(Clinic(spark, sf_dir))
    return p.select("subject_id", X.fmt_percent("risk_score").alias("risk_pct"),
                    X.fmt_percent("emergency_ratio").alias("emergency_pct"),
                    X.fmt_fixed("avg_los_days", 1).alias("avg_stay"),
                    X.fmt_fixed("days_since_last_admission", 0).alias("days_since"))


@register("format_browser", f"""
SELECT subject_id, {fmt_browser('subject_id / CAST(8 AS DOUBLE)', 1)} AS eighths,
       {fmt_browser('(risk_score - 0.5) * 100', 1)} AS centred_pct, {fmt_browser('risk_score * 100', 1)} || '%' AS risk_pct
FROM scores""")
def q_format_browser(spark, sf_dir):
    """Figures as the dashboard prints them: ties (eighths have many) go up, where report texts go to even."""
    s = F.col("risk_score")
    return Clinic(spark, sf_dir).scores.select(
        "subject_id", X.fmt_browser(F.col("subject_id") / F.lit(8.0), 1).alias("eighths"),
        X.fmt_browser((s - 0.5) * 100, 1).alias("centred_pct"),
        F.concat(X.fmt_browser(s * 100, 1), F.lit("%")).alias("risk_pct"))


@register("driver_name", """
SELECT DISTINCT feature, CASE feature WHEN 'shap_admission_count' THEN 'Admission Count'
  WHEN 'shap_emergency_ratio' THEN 'Emergency Ratio' WHEN 'shap_days_since_last_admission' THEN 'Days Since Last Admission'
  ELSE 'Has Previous Admission' END AS feature_name FROM shap_long""")
def q_driver_name(spark, sf_dir):
    long = SV.shap_long(Clinic(spark, sf_dir).shap_fixture)
    return long.select("feature", X.driver_name("feature").alias("feature_name")).distinct()


@register("driver_direction", """
SELECT subject_id, feature, CASE WHEN value > 0 THEN 'increases' ELSE 'decreases' END AS direction,
       CASE WHEN value > 0 THEN 'high' ELSE 'low' END AS level FROM shap_long""")
def q_driver_direction(spark, sf_dir):
    long = SV.shap_long(Clinic(spark, sf_dir).shap_fixture)
    return long.select("subject_id", "feature", X.driver_direction("value").alias("direction"),
                       X.driver_direction("value", "high", "low").alias("level"))


_WARD_CASE = ("CASE predicted_ward " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in S.WARD_CONTEXT.items())
              + f" ELSE {lit(S.WARD_CONTEXT_DEFAULT)} END")


@register("ward_context", f"SELECT subject_id, predicted_ward, {_WARD_CASE} AS ward_context FROM scores")
def q_ward_context(spark, sf_dir):
    s = Clinic(spark, sf_dir).scores
    return s.select("subject_id", "predicted_ward", X.ward_context("predicted_ward").alias("ward_context"))


@register("clean_report_text", "SELECT note_id, replace(replace(text, '**', ''), chr(10), '<br/>') AS report_text FROM notes")
def q_clean_report_text(spark, sf_dir):
    n = Clinic(spark, sf_dir).notes
    return n.select("note_id", X.clean_report_text("text").alias("report_text"))


@register("clean_explanation_text", "SELECT note_id, replace(text, chr(10), '<br/>') AS report_text FROM notes")
def q_clean_explanation_text(spark, sf_dir):
    """The explanation's form: line ends only, bold markers stay."""
    n = Clinic(spark, sf_dir).notes
    return n.select("note_id", X.clean_report_text("text", markers=False).alias("report_text"))


@register("join_scores_features", f"SELECT s.subject_id, s.risk_score, f.admission_count FROM scores s JOIN features f ON s.subject_id = f.subject_id")
def q_join_scores_features(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    return SV.join_scores_features(c.scores, c.features).select("subject_id", "risk_score", "admission_count")


@register("lookup_shap", """
SELECT s.subject_id, s.risk_score, h.shap_admission_count, h.shap_emergency_ratio,
       h.shap_days_since_last_admission, h.shap_has_previous_admission
FROM scores s LEFT JOIN shap_fixture h ON s.subject_id = h.subject_id""")
def q_lookup_shap(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    return c.scores.select("subject_id", "risk_score").join(c.shap_fixture, "subject_id", "left")


@register("tier_counts", "SELECT risk_tier, COUNT(*) AS n FROM scores WHERE risk_tier IS NOT NULL GROUP BY risk_tier")
def q_tier_counts(spark, sf_dir):
    return SV.value_counts(Clinic(spark, sf_dir).scores, "risk_tier")


@register("value_counts", """
SELECT high_risk_label, COUNT(*) AS n FROM patient_features WHERE high_risk_label IS NOT NULL GROUP BY high_risk_label""")
def q_value_counts(spark, sf_dir):
    return SV.value_counts(Clinic(spark, sf_dir).base_features, "high_risk_label")


@register("ward_counts", "SELECT predicted_ward, COUNT(*) AS n FROM scores WHERE predicted_ward IS NOT NULL GROUP BY predicted_ward")
def q_ward_counts(spark, sf_dir):
    return SV.value_counts(Clinic(spark, sf_dir).scores, "predicted_ward")


@register("dashboard_stats", f"""
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE risk_tier = 'HIGH') AS n_high,
       COUNT(*) FILTER (WHERE risk_tier = 'MEDIUM') AS n_medium, COUNT(*) FILTER (WHERE risk_tier = 'LOW') AS n_low,
       {fmt_browser('AVG(risk_score) * 100.0', 1)} AS avg_score_pct
FROM (SELECT DISTINCT {LIST_COLS} FROM scores s JOIN features f USING (subject_id))""")
def q_dashboard_stats(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    rows = (SV.join_scores_features(c.scores, c.features)
            .select("subject_id", "risk_score", "risk_tier", "admission_count", "emergency_ratio").distinct())
    return SV.dashboard_stats(rows)


@register("score_histogram", f"""
SELECT b.bucket, COALESCE(n, 0) AS n,
       CASE WHEN b.bucket / 10.0 >= 0.7 THEN 'HIGH' WHEN b.bucket / 10.0 >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS band
FROM (SELECT CAST(range AS INTEGER) AS bucket FROM range(10)) b
LEFT JOIN (SELECT CAST(least(floor(risk_score * 10), 9) AS INTEGER) AS bucket, COUNT(*) AS n
           FROM (SELECT DISTINCT {LIST_COLS} FROM scores s JOIN features f USING (subject_id))
           WHERE risk_score IS NOT NULL GROUP BY 1) c ON b.bucket = c.bucket""")
def q_score_histogram(spark, sf_dir):
    """Histogram over the dashboard's patient rows (the same rows as dashboard_stats)."""
    c = Clinic(spark, sf_dir)
    rows = (SV.join_scores_features(c.scores, c.features)
            .select("subject_id", "risk_score", "risk_tier", "admission_count", "emergency_ratio").distinct())
    return SV.score_histogram(spark, rows)


_DESCRIBE_COLS = ["age", "charlson_score", "num_diagnoses", "num_icu_stays", "total_icu_hours"]


@register("describe", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, COUNT({c}) AS count, round(AVG({c}), 9) AS mean, round(stddev_samp({c}), 9) AS std,
       CAST(MIN({c}) AS DOUBLE) AS min,
       quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75,
       CAST(MAX({c}) AS DOUBLE) AS max FROM enhanced""" for c in _DESCRIBE_COLS))
def q_describe(spark, sf_dir):
    return SV.describe(Clinic(spark, sf_dir).enhanced, _DESCRIBE_COLS)


@register("class_balance", """
SELECT COUNT(*) FILTER (WHERE high_risk_label = 0) AS neg, COUNT(*) FILTER (WHERE high_risk_label = 1) AS pos,
       CASE WHEN COUNT(*) FILTER (WHERE high_risk_label = 1) > 0
            THEN COUNT(*) FILTER (WHERE high_risk_label = 0) / COUNT(*) FILTER (WHERE high_risk_label = 1)
            ELSE 1.0 END AS scale_pos_weight
FROM patient_features""")
def q_class_balance(spark, sf_dir):
    return SV.class_balance(Clinic(spark, sf_dir).base_features)


@register("distinct_patients", f"SELECT DISTINCT {LIST_COLS} FROM scores s JOIN features f USING (subject_id)")
def q_distinct_patients(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    return (SV.join_scores_features(c.scores, c.features)
            .select("subject_id", "risk_score", "risk_tier", "admission_count", "emergency_ratio").distinct())


@register("dedup_patients", "SELECT subject_id, gender, dob FROM patients")
def q_dedup_patients(spark, sf_dir):
    return Clinic(spark, sf_dir).patients


@register("dedup_admissions", "SELECT hadm_id, subject_id, admittime, dischtime, admission_type FROM admissions")
def q_dedup_admissions(spark, sf_dir):
    return Clinic(spark, sf_dir).admissions


@register("top_patient", "SELECT subject_id, risk_score FROM scores ORDER BY risk_score DESC, subject_id LIMIT 1")
def q_top_patient(spark, sf_dir):
    return SV.top_patient(Clinic(spark, sf_dir).scores)


@register("rank_drivers", "SELECT subject_id, feature, position, value, rank FROM drivers")
def q_rank_drivers(spark, sf_dir):
    return SV.rank_drivers(Clinic(spark, sf_dir).shap_fixture)


@register("top3_drivers", "SELECT subject_id, feature, position, value, rank FROM drivers WHERE rank <= 3")
def q_top3_drivers(spark, sf_dir):
    return SV.top_drivers(Clinic(spark, sf_dir).shap_fixture, 3)


@register("shap_global", "SELECT feature, round(AVG(abs(value)), 9) AS mean_abs_shap FROM shap_long GROUP BY feature")
def q_shap_global(spark, sf_dir):
    return SV.shap_global(Clinic(spark, sf_dir).shap_fixture)


def _list_sql(where: str, limit: int) -> str:
    return (f"SELECT * FROM (SELECT DISTINCT {LIST_COLS} FROM scores s JOIN features f USING (subject_id)) {where} "
            f"ORDER BY risk_score DESC, subject_id LIMIT {limit}")


@register("list_patients", _list_sql("", 100))
def q_list_patients(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    return SV.list_patients(c.scores, c.features, limit=100)


@register("filter_tier", _list_sql("WHERE risk_tier = 'MEDIUM'", 100))
def q_filter_tier(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    return SV.list_patients(c.scores, c.features, limit=100, tier="medium")


@register("list_patients_by_tier", f"""
SELECT * FROM (
  SELECT {LIST_COLS}, row_number() OVER (PARTITION BY risk_tier ORDER BY risk_score DESC, subject_id) AS rank
  FROM scores s JOIN features f USING (subject_id) WHERE risk_tier IN ('HIGH', 'MEDIUM', 'LOW')) WHERE rank <= 500""")
def q_list_patients_by_tier(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    return SV.list_patients_by_tier(c.scores, c.features, 500)


@register("high_risk_patients", f"""
SELECT *, COUNT(*) OVER () AS count FROM ({_list_sql("WHERE risk_tier = 'HIGH'", 20)})""")
def q_high_risk_patients(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    top = SV.list_patients(c.scores, c.features, limit=20, tier="HIGH")
    # the response's count field: a window over the (at most 20) top-k rows
    return top.withColumn("count", F.count(F.lit(1)).over(Window.partitionBy()))


@register("top10_risk", "SELECT subject_id, risk_score, risk_tier FROM scores ORDER BY risk_score DESC, subject_id LIMIT 10")
def q_top10_risk(spark, sf_dir):
    return SV.top_k(Clinic(spark, sf_dir).scores, 10, ["subject_id", "risk_score", "risk_tier"])


@register("top10_ward", """
SELECT subject_id, risk_score, predicted_ward FROM scores ORDER BY risk_score DESC, subject_id LIMIT 10""")
def q_top10_ward(spark, sf_dir):
    return SV.top_k(Clinic(spark, sf_dir).scores, 10, ["subject_id", "risk_score", "predicted_ward"])


@register("patient_profile", "SELECT * FROM profile")
def q_patient_profile(spark, sf_dir):
    return _profile(Clinic(spark, sf_dir))


@register("point_lookup", """
SELECT r.subject_id, p.subject_id IS NOT NULL AS found, p.risk_score, p.risk_tier
FROM (SELECT DISTINCT subject_id FROM questions_raw) r LEFT JOIN profile p ON r.subject_id = p.subject_id""")
def q_point_lookup(spark, sf_dir):
    """The serving table, stored by id for the state of its inputs, read for the requested ids only."""
    return SV.point_lookup(Clinic(spark, sf_dir).questions, serving_table(spark, sf_dir)).select(
        "subject_id", "found", "risk_score", "risk_tier")


def serving_table(spark, sf_dir):
    """Patient profiles laid out for lookups by id; written once for a state of the input files."""
    state = input_fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in ("customer", "orders", "lineitem", "events")], "profile", 1)
    folder = get_or_build(spark, shared_path(spark, "serving", unique=False), "profile", state,
                          lambda f: write_lookup(_profile(Clinic(spark, sf_dir)), f, "subject_id"))
    return spark.read.parquet(folder)


@register("ward_summary", "SELECT subject_id, risk_score, risk_tier, predicted_ward, estimated_los_days FROM profile")
def q_ward_summary(spark, sf_dir):
    return SV.ward_summary(_profile(Clinic(spark, sf_dir)))


_SUMMARY_VALUES = [
    ("Patient ID", "CAST(subject_id AS VARCHAR)"),
    ("Risk Score", pct("COALESCE(risk_score, 0)")),
    ("Risk Tier", "COALESCE(risk_tier, 'N/A')"),
    ("Assigned Ward", "COALESCE(predicted_ward, 'N/A')"),
    ("Est. Stay", fmt("COALESCE(estimated_los_days, 0)", 1) + " || ' days'"),
    ("Admissions", "CAST(COALESCE(admission_count, 0) AS VARCHAR)"),
    ("Emergency Rate", pct("COALESCE(emergency_ratio, 0)")),
    ("Avg Stay", fmt("COALESCE(avg_los_days, 0)", 1) + " || ' days'"),
]


@register("report_summary_rows", " UNION ALL ".join(
    f"SELECT subject_id, {i + 1} AS position, {lit(name)} AS field, {v} AS value FROM profile"
    for i, (name, v) in enumerate(_SUMMARY_VALUES)))
def q_report_summary_rows(spark, sf_dir):
    return SV.report_summary_rows(_profile(Clinic(spark, sf_dir)))


_FEATURE_NAME = ("CASE feature WHEN 'shap_admission_count' THEN 'Admission Count' WHEN 'shap_emergency_ratio' THEN 'Emergency Ratio' "
                 "WHEN 'shap_days_since_last_admission' THEN 'Days Since Last Admission' ELSE 'Has Previous Admission' END")


@register("report_driver_rows", f"""
SELECT subject_id, rank, {_FEATURE_NAME} AS feature_name, {fmt('abs(value)', 4)} AS impact,
       CASE WHEN value > 0 THEN '↑ Increases Risk' ELSE '↓ Decreases Risk' END AS direction
FROM drivers""")
def q_report_driver_rows(spark, sf_dir):
    return SV.report_driver_rows(Clinic(spark, sf_dir).shap_fixture)


def _risk_prompt_sql(template: str, line_sql: str) -> str:
    vals = {"subject_id": "p.subject_id", "risk_pct": pct("p.risk_score"),
            "risk_tier": "COALESCE(p.risk_tier, 'None')", "admission_count": "p.admission_count",
            "emergency_pct": pct("p.emergency_ratio"), "avg_stay": fmt("p.avg_los_days", 1),
            "days_since": fmt("p.days_since_last_admission", 0), "driver_lines": "l.driver_lines"}
    return f"""
SELECT p.subject_id, {fill(template, vals)} AS prompt
FROM profile p JOIN (
  SELECT subject_id, string_agg({line_sql}, chr(10) ORDER BY rank) AS driver_lines FROM drivers GROUP BY subject_id
) l ON p.subject_id = l.subject_id"""


_API_LINE = ("printf('  - %s: %s risk (impact=%s)', replace(feature, 'shap_', ''), "
             "CASE WHEN value > 0 THEN 'increases' ELSE 'decreases' END, " + fmt("abs(value)", 3) + ")")
_CLI_LINE = ("printf('  - %s: SHAP=%s (%s risk)', replace(feature, 'shap_', ''), " + fmt("value", 4, sign=True)
             + ", CASE WHEN value > 0 THEN 'increases' ELSE 'decreases' END)")


@register("prompt_risk", _risk_prompt_sql(P.RISK_PROMPT, _API_LINE))
def q_prompt_risk(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    return P.prompt_risk(_profile(c), c.shap_fixture, "api")


@register("prompt_risk_cli", _risk_prompt_sql(P.RISK_PROMPT_CLI, _CLI_LINE))
def q_prompt_risk_cli(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    return P.prompt_risk(_profile(c), c.shap_fixture, "cli")


_WARD_OF = "COALESCE(p.predicted_ward, 'General')"
_DISCHARGE_VALS = {
    "subject_id": "p.subject_id", "risk_pct": pct("COALESCE(p.risk_score, 0)"),
    "risk_tier": "COALESCE(p.risk_tier, 'None')", "ward": _WARD_OF,
    "ward_context": "CASE " + _WARD_OF + " " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in S.WARD_CONTEXT.items())
                    + f" ELSE {lit(S.WARD_CONTEXT_DEFAULT)} END",
    "los": fmt("COALESCE(p.estimated_los_days, 3)", 1), "top_drivers": "COALESCE(t.top_drivers, '')",
    "admission_count": "p.admission_count", "emergency_pct": pct("p.emergency_ratio"),
}


_DISCHARGE_SQL = f"""
SELECT p.subject_id, {fill(P.DISCHARGE_PROMPT, _DISCHARGE_VALS)} AS prompt
FROM profile p LEFT JOIN (
  SELECT subject_id, string_agg(printf('%s (%s impact)', replace(feature, 'shap_', ''),
                                       CASE WHEN value > 0 THEN 'high' ELSE 'low' END), ', ' ORDER BY rank) AS top_drivers
  FROM drivers WHERE rank <= 3 GROUP BY subject_id) t ON p.subject_id = t.subject_id"""


@register("prompt_discharge", _DISCHARGE_SQL)
def q_prompt_discharge(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    return P.prompt_discharge(_profile(c), c.shap_fixture)


_DIRECTION = "CASE WHEN value > 0 THEN '↑ Increases Risk' ELSE '↓ Decreases Risk' END"
_SUMMARY_LIST = ", ".join(f"{{'position': {i + 1}, 'field': {lit(name)}, 'value': {v}}}"
                          for i, (name, v) in enumerate(_SUMMARY_VALUES))


@register("patient_report", f"""
SELECT p.subject_id, p.summary, COALESCE(d.drivers, '[]') AS drivers, r.prompt AS explanation_prompt, g.prompt AS discharge_prompt
FROM (SELECT subject_id, CAST(to_json([{_SUMMARY_LIST}]) AS VARCHAR) AS summary FROM profile) p LEFT JOIN (
  SELECT subject_id, CAST(to_json(list({{'rank': rank, 'feature_name': {_FEATURE_NAME}, 'impact': {fmt('abs(value)', 4)},
                                        'direction': {_DIRECTION}}} ORDER BY rank)) AS VARCHAR) AS drivers
  FROM drivers GROUP BY subject_id) d ON d.subject_id = p.subject_id
LEFT JOIN ({_risk_prompt_sql(P.RISK_PROMPT, _API_LINE)}) r ON r.subject_id = p.subject_id
LEFT JOIN ({_DISCHARGE_SQL}) g ON g.subject_id = p.subject_id""")
def q_patient_report(spark, sf_dir):
    """One row per scored patient: summary and driver entries as JSON, both prompts."""
    c = Clinic(spark, sf_dir)
    return P.patient_report(_profile(c), c.shap_fixture).withColumns(
        {k: F.to_json(k) for k in ("summary", "drivers")})
