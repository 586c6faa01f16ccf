"""Physical-plan shape: what each operator must (not) compile to."""

import __spark_entry__ as E
from carepath.operators import features as FE
from carepath.plans.context import Clinic
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_charlson_prefix_join_is_broadcast_equi_join(spark):
    c = Clinic(spark, SF_SMALL)
    plan = _plan(FE.prefix_join_charlson(FE.diagnosis_codes(c.diagnoses_raw), FE.charlson_lookup(spark)))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_list_is_top_k_not_full_sort(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(E.queries()["list_patients"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "TakeOrderedAndProject" in plan


def test_retrieval_limits_groups_before_shuffle(spark):
    df = E.queries()["retrieve_topk"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_no_python_udf_outside_attribution(spark):
    for name, fn in E.queries().items():
        if name in ("shap_values", "shap_waterfall", "ward_importance") or name.startswith(("enhanced_", "train_", "score_", "cross_", "cv_", "compare_",
                                                         "model_", "feature_imp", "stratified")):
            continue
        plan = _plan(fn(spark, SF_SMALL))
        for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
            assert bad not in plan, (name, bad)


def test_scans_prune_columns(spark):
    c = Clinic(spark, SF_SMALL)
    plan = _plan(c.base_features)
    assert "o_totalprice" not in plan and "o_orderstatus" not in plan


def test_drivers_are_ranked_in_the_row(spark):
    for name in ("rank_drivers", "top3_drivers", "report_driver_rows"):
        plan = _plan(E.queries()[name](spark, SF_SMALL))
        assert "Exchange" not in plan and "Window" not in plan, name


def test_report_reads_each_table_once(spark):
    from carepath.operators import serve as SV
    c = Clinic(spark, SF_SMALL)
    used = SV.patient_profile(c.scores, c.features).select(
        "subject_id", "risk_score", "risk_tier", "predicted_ward", "estimated_los_days", "admission_count", "emergency_ratio",
        "avg_los_days", "days_since_last_admission")
    report, profile = (df._jdf.queryExecution().optimizedPlan().toString()
                       for df in (E.queries()["patient_report"](spark, SF_SMALL), used))
    # the profile's scans and one more of the attributions' table
    assert report.count("Relation [") == profile.count("Relation [") + 1
