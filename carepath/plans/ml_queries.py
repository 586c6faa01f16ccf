"""Model training, scoring, evaluation and attribution.

All models train with the library defaults (100 rounds or trees, 300 rounds for
the enhanced model). Fitted models, their rows and hold-out predictions are stored by the state of
the input files; queries on one model share a fit.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from carepath import schemas as S
from carepath.functions import scalar as X
from carepath.operators import ml as ML
from carepath.operators import serve as SV
from carepath.operators import shap as SH
from carepath.plans.catalog import register
from carepath.plans.context import Clinic
from carepath.session import shared_path
from carepath.sources.tables import write_version
from carepath.sources.versions import get_or_build, input_fingerprint

#: Changes whenever what is stored with a model changes.
_STORE_FORMAT = 2


def _stored(spark, sf_dir: str, name: str, build, rebuild: bool = False) -> str:
    """Folder of what ``build(clinic, folder)`` stores for this data directory: made once for a state of the
    input files (names, sizes, times), again when they change."""
    state = input_fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in ("customer", "orders", "lineitem", "events")],
                              name, _STORE_FORMAT)
    return get_or_build(spark, shared_path(spark, "models", unique=False), name, state,
                        lambda folder: build(Clinic(spark, sf_dir), folder), rebuild)


def _train_input(c: Clinic, cols=S.BASIC_FEATURES, recency=-1.0):
    """The labelled training rows, stored once: fitting, class counts and scoring
    each read the stored table instead of re-running the feature job."""
    df = ML.training_frame(c.features, cols, recency_default=recency)
    return write_version(df, shared_path(c.spark, "training_rows"))


def _split(c: Clinic, cols=S.BASIC_FEATURES, recency=-1.0):
    return ML.stratified_split(_train_input(c, cols, recency)).checkpoint(eager=True)


def _holdout(model, split):
    return ML.score(model, split.filter(F.col("split") == "test"))


_NZV_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(stddev_samp({'COALESCE(' + c + ', 0)'}), 9) AS std, "
    f"COALESCE(stddev_samp({'COALESCE(' + c + ', 0)'}) > 0, false) AS keep "
    f"FROM features WHERE high_risk_label IS NOT NULL"
    for c in S.ENHANCED_FEATURES)


@register("nonzero_variance", _NZV_SQL)
def q_nonzero_variance(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    return ML.nonzero_variance(_train_input(c, S.ENHANCED_FEATURES, 0.0), S.ENHANCED_FEATURES)


@register("class_weight", """
SELECT subject_id, high_risk_label AS label,
       COUNT(*) OVER () / (2.0 * COUNT(*) OVER (PARTITION BY high_risk_label)) AS weight
FROM patient_features WHERE high_risk_label IS NOT NULL""")
def q_class_weight(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    return ML.class_weights(_train_input(c)).select("subject_id", "label", "weight")


_STD_COLS = ", ".join(
    f"({x} - round(AVG({x}) OVER (), 9)) / COALESCE(NULLIF(round(STDDEV_POP({x}) OVER (), 9), 0), 1) AS {n}"
    for n, x in [("admission_count", "CAST(admission_count AS DOUBLE)"), ("emergency_ratio", "COALESCE(emergency_ratio, 0)"),
                 ("days_since_last_admission", "COALESCE(days_since_last_admission, -1)"),
                 ("has_previous_admission", "CAST(has_previous_admission AS DOUBLE)")])


@register("standardize", f"SELECT subject_id, {_STD_COLS} FROM patient_features WHERE high_risk_label IS NOT NULL")
def q_standardize(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    df = _train_input(c)
    return ML.standardize(df, ML.standardize_params(df, S.BASIC_FEATURES)).select("subject_id", *S.BASIC_FEATURES)


_SPLIT_SQL = """
SELECT subject_id, label, CASE WHEN r <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT subject_id, high_risk_label AS label, COUNT(*) OVER (PARTITION BY high_risk_label) AS n,
         row_number() OVER (PARTITION BY high_risk_label ORDER BY md5(CAST(subject_id AS VARCHAR) || ':42'), subject_id) AS r
  FROM patient_features WHERE high_risk_label IS NOT NULL)"""


@register("stratified_split", _SPLIT_SQL)
def q_stratified_split(spark, sf_dir):
    return _split(Clinic(spark, sf_dir)).select("subject_id", "label", "split")


@register("stratified_folds", """
SELECT subject_id, high_risk_label AS label, CAST((row_number() OVER (
  PARTITION BY high_risk_label ORDER BY md5(CAST(subject_id AS VARCHAR) || ':42'), subject_id) - 1) % 5 AS INTEGER) AS fold
FROM features WHERE high_risk_label IS NOT NULL""")
def q_stratified_folds(spark, sf_dir):
    """The five folds of the enhanced model's cross-validation."""
    c = Clinic(spark, sf_dir)
    return ML.stratified_folds(_train_input(c, S.ENHANCED_FEATURES, 0.0)).select("subject_id", "label", "fold")


@register("train_logistic")
def q_train_logistic(spark, sf_dir):
    sp = ML.class_weights(_split(Clinic(spark, sf_dir)))
    params = ML.standardize_params(sp.filter("split = 'train'"), S.BASIC_FEATURES)
    sp = ML.standardize(sp, params)
    model = ML.train_logistic(sp.filter("split = 'train'"), S.BASIC_FEATURES)
    return _holdout(model, sp).select("subject_id", "label", "risk_score", "risk_prediction")


@register("train_forest")
def q_train_forest(spark, sf_dir):
    sp = ML.class_weights(_split(Clinic(spark, sf_dir)))
    model = ML.train_forest(sp.filter("split = 'train'"), S.BASIC_FEATURES)
    return _holdout(model, sp).select("subject_id", "label", "risk_score", "risk_prediction")


@register("train_gbt_base")
def q_train_gbt_base(spark, sf_dir):
    sp = ML.class_weights(_split(Clinic(spark, sf_dir)), mode="pos_scale")
    model = ML.train_gbt_base(sp.filter("split = 'train'"))
    return _holdout(model, sp).select("subject_id", "label", "risk_score", "risk_prediction")


def _enhanced_rows(c: Clinic):
    base = _train_input(c, S.ENHANCED_FEATURES, 0.0)
    return base, ML.kept_features(base, S.ENHANCED_FEATURES)


def _build_enhanced(c: Clinic, folder: str) -> None:
    """The enhanced model fitted on the training split, and its predictions for the hold-out."""
    base, cols = _enhanced_rows(c)
    sp = ML.class_weights(ML.stratified_split(base).checkpoint(eager=True), mode="pos_scale")
    model = ML.train_gbt_enhanced(sp.filter("split = 'train'"), cols)
    ML.save_model(model, f"{folder}/model")
    _holdout(model, sp).select("subject_id", "label", "risk_score", "risk_prediction").write.parquet(f"{folder}/holdout")


def _enhanced_holdout(spark, sf_dir):
    return spark.read.parquet(_stored(spark, sf_dir, "enhanced", _build_enhanced) + "/holdout")


@register("train_gbt_enhanced")
def q_train_gbt_enhanced(spark, sf_dir):
    return _enhanced_holdout(spark, sf_dir)


@register("enhanced_report")
def q_enhanced_report(spark, sf_dir):
    """Hold-out report of the enhanced model with its ROC-AUC and the quality gate."""
    return ML.holdout_report(_enhanced_holdout(spark, sf_dir))


@register("enhanced_importance")
def q_enhanced_importance(spark, sf_dir):
    model = ML.load_model(_stored(spark, sf_dir, "enhanced", _build_enhanced) + "/model")
    return ML.feature_importance(spark, model, model.stages[0].getInputCols())


@register("cross_validate_enhanced")
def q_cross_validate_enhanced(spark, sf_dir):
    """ROC-AUC of the enhanced model per fold, with the mean and deviation over the five."""
    base, cols = _enhanced_rows(Clinic(spark, sf_dir))
    rows = ML.class_weights(base, mode="pos_scale")
    per = ML.cross_validate(rows, lambda train: ML.train_gbt_enhanced(train, cols))
    return per.withColumns({c: ML.cv_summary(per).select(c).scalar() for c in ("mean", "std")})


@register("compare_models")
def q_compare_models(spark, sf_dir):
    """Report rows and ROC-AUC of the three basic-feature models on one hold-out."""
    sp = _split(Clinic(spark, sf_dir))
    bal = ML.class_weights(sp)
    params = ML.standardize_params(bal.filter("split = 'train'"), S.BASIC_FEATURES)
    std = ML.standardize(bal, params)
    posw = ML.class_weights(sp, mode="pos_scale")
    fits = {
        "logistic": lambda: _holdout(ML.train_logistic(std.filter("split = 'train'"), S.BASIC_FEATURES), std),
        "forest": lambda: _holdout(ML.train_forest(bal.filter("split = 'train'"), S.BASIC_FEATURES), bal),
        "gbt": lambda: _holdout(ML.train_gbt_base(posw.filter("split = 'train'")), posw),
    }
    runs = ML.side_by_side(spark, fits)
    out = None
    for name, pred in runs.items():
        rep = ML.classification_report(pred, prediction="risk_prediction")
        auc = ML.roc_auc(pred).first()["roc_auc"]
        rep = rep.withColumn("model", F.lit(name)).withColumn("roc_auc", F.lit(auc))
        out = rep if out is None else out.unionByName(rep)
    return out


@register("encode_ward", """
SELECT subject_id, predicted_ward, CAST(DENSE_RANK() OVER (ORDER BY predicted_ward) - 1 AS DOUBLE) AS label
FROM scores WHERE predicted_ward IS NOT NULL""")
def q_encode_ward(spark, sf_dir):
    s = Clinic(spark, sf_dir).scores.filter(F.col("predicted_ward").isNotNull())
    return ML.ward_indexer().fit(s).transform(s).select("subject_id", "predicted_ward", "label")


def _ward_data(c: Clinic):
    f = c.base_features.select("subject_id", "admission_count", "emergency_ratio", "avg_los_days", "max_los_days",
                               F.coalesce("days_since_last_admission", F.lit(-1.0)).alias("days_since_last_admission"),
                               "has_previous_admission")
    j = f.join(c.scores.select("subject_id", "risk_score", "predicted_ward"), "subject_id")
    return j.select("subject_id", *[F.col(x).cast("double") for x in S.WARD_FEATURES], "predicted_ward")


@register("decode_ward", """
SELECT subject_id, CAST(DENSE_RANK() OVER (ORDER BY predicted_ward) - 1 AS DOUBLE) AS label,
       predicted_ward AS ward_decoded
FROM scores WHERE predicted_ward IS NOT NULL""")
def q_decode_ward(spark, sf_dir):
    """Index -> label with the fitted indexer's labels (round trip of encode_ward)."""
    from pyspark.ml.feature import IndexToString
    s = Clinic(spark, sf_dir).scores.filter(F.col("predicted_ward").isNotNull())
    enc = ML.ward_indexer().fit(s)
    idx = enc.transform(s).select("subject_id", "label")
    dec = IndexToString(inputCol="label", outputCol="ward_decoded", labels=enc.labels)
    return dec.transform(idx)


def _ward_split(c: Clinic):
    data = _ward_data(c).filter(F.col("predicted_ward").isNotNull())
    return ML.stratified_split(data, label="predicted_ward").checkpoint(eager=True)


def _build_ward_holdout(c: Clinic, folder: str) -> None:
    """Ward model of the training split with its hold-out predictions."""
    sp = _ward_split(c)
    model = ML.train_ward(sp.filter("split = 'train'"))
    ML.save_model(model, f"{folder}/model")
    (ML.score_ward(model, sp.filter("split = 'test'")).select("subject_id", "predicted_ward", "ward_pred", "ward_probability")
     .write.parquet(f"{folder}/holdout"))


def _build_ward(c: Clinic, folder: str) -> None:
    """Ward model of all labelled rows."""
    ML.save_model(ML.train_ward(_ward_split(c)), f"{folder}/model")


@register("train_ward")
def q_train_ward(spark, sf_dir):
    """Hold-out classification report of the ward model (labelled rows only)."""
    pred = spark.read.parquet(_stored(spark, sf_dir, "ward_holdout", _build_ward_holdout) + "/holdout")
    return ML.classification_report(pred, label="predicted_ward", prediction="ward_pred")


@register("ward_importance")
def q_ward_importance(spark, sf_dir):
    return ML.ward_importance(spark, ML.load_model(_stored(spark, sf_dir, "ward_holdout", _build_ward_holdout) + "/model"))


@register("score_ward")
def q_score_ward(spark, sf_dir):
    """Ward and confidence for every scored patient; trained on the labelled ones."""
    model = ML.load_model(_stored(spark, sf_dir, "ward", _build_ward) + "/model")
    return ML.score_ward(model, _ward_data(Clinic(spark, sf_dir))).select(
        "subject_id", "risk_score", F.col("ward_pred").alias("predicted_ward"), "ward_probability")


@register("round_confidence", """
SELECT subject_id, round_even(greatest(risk_score / 16, 1 - risk_score / 16) * 1000, 0) / 1000 AS ward_probability FROM scores""")
def q_round_confidence(spark, sf_dir):
    """Largest of two class probabilities per patient to 3 places, over stored scores (sixteenths make ties)."""
    p = F.col("risk_score") / 16
    return Clinic(spark, sf_dir).scores.select("subject_id", X.round_confidence(F.array(p, 1 - p)).alias("ward_probability"))


@register("score_patients")
def q_score_patients(spark, sf_dir):
    """Final model on all labelled rows, then risk score, prediction and tier for each."""
    df, path = _fitted_gbt(spark, sf_dir)
    return ML.score(ML.load_model(path), df).select("subject_id", "risk_score", "risk_prediction", "risk_tier")


@register("cross_validate")
def q_cross_validate(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    return ML.cross_validate(ML.class_weights(_train_input(c), mode="pos_scale"), ML.train_gbt_base)


@register("cv_summary", """
WITH f AS (
  SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(CAST(subject_id AS VARCHAR) || ':42'), subject_id) - 1) % 5 AS fold
  FROM risk_fixture),
per AS (SELECT fold, risk_score AS s, COUNT(*) FILTER (WHERE label = 1) AS pos, COUNT(*) FILTER (WHERE label = 0) AS neg
        FROM f GROUP BY fold, risk_score),
cum AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY fold ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
        FROM per),
auc AS (SELECT fold, SUM(pos * (neg_below + neg * 0.5)) / (SUM(pos) * SUM(neg)) AS roc_auc FROM cum GROUP BY fold)
SELECT AVG(roc_auc) AS mean, STDDEV_POP(roc_auc) AS std, COUNT(roc_auc) AS folds FROM auc""")
def q_cv_summary(spark, sf_dir):
    """Mean and deviation of the folds' ROC-AUC over stored predictions."""
    pred = Clinic(spark, sf_dir).risk_fixture.select("subject_id", "label", "risk_score")
    return ML.cv_summary(ML.fold_auc(ML.stratified_folds(pred).checkpoint(eager=True)))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    _, path = _fitted_gbt(spark, sf_dir)
    return ML.feature_importance(spark, ML.load_model(path), S.BASIC_FEATURES)


@register("classification_report", """
WITH pr AS (SELECT CAST(label AS VARCHAR) AS y, CAST(CASE WHEN risk_score > 0.5 THEN 1 ELSE 0 END AS VARCHAR) AS p
            FROM risk_fixture),
per AS (
  SELECT c.cls, (SELECT COUNT(*) FROM pr WHERE y = c.cls) AS support,
         COALESCE((SELECT COUNT(*) FROM pr WHERE y = c.cls AND p = c.cls) / NULLIF((SELECT COUNT(*) FROM pr WHERE p = c.cls), 0), 0) AS precision,
         COALESCE((SELECT COUNT(*) FROM pr WHERE y = c.cls AND p = c.cls) / NULLIF((SELECT COUNT(*) FROM pr WHERE y = c.cls), 0), 0) AS recall
  FROM (SELECT y AS cls FROM pr UNION SELECT p FROM pr) c),
per2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM per)
SELECT cls, support, precision, recall, f1 FROM per2
UNION ALL SELECT 'accuracy', (SELECT COUNT(*) FROM pr), NULL, NULL, (SELECT COUNT(*) FROM pr WHERE y = p) / (SELECT COUNT(*) FROM pr)
UNION ALL SELECT 'macro avg', SUM(support), round(AVG(precision), 9), round(AVG(recall), 9), round(AVG(f1), 9) FROM per2
UNION ALL SELECT 'weighted avg', SUM(support), round(SUM(precision * support), 9) / SUM(support),
                 round(SUM(recall * support), 9) / SUM(support), round(SUM(f1 * support), 9) / SUM(support) FROM per2""")
def q_classification_report(spark, sf_dir):
    r = Clinic(spark, sf_dir).risk_fixture
    pred = r.select("label", (F.col("risk_score") > 0.5).cast("int").alias("prediction"))
    return ML.classification_report(pred)


@register("confusion_matrix", """
SELECT label, COUNT(*) FILTER (WHERE risk_score <= 0.5) AS pred_0, COUNT(*) FILTER (WHERE risk_score > 0.5) AS pred_1
FROM risk_fixture GROUP BY label""")
def q_confusion_matrix(spark, sf_dir):
    r = Clinic(spark, sf_dir).risk_fixture
    pred = r.select("label", (F.col("risk_score") > 0.5).cast("int").alias("prediction"))
    return ML.confusion_matrix(pred, classes=[0, 1])


_AUC_SQL = """
WITH per AS (SELECT risk_score AS s, COUNT(*) FILTER (WHERE label = 1) AS pos, COUNT(*) FILTER (WHERE label = 0) AS neg
             FROM risk_fixture GROUP BY risk_score),
cum AS (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM per)
SELECT SUM(pos * (neg_below + neg * 0.5)) / (SUM(pos) * SUM(neg)) AS roc_auc FROM cum"""


@register("roc_auc", _AUC_SQL)
def q_roc_auc(spark, sf_dir):
    return ML.roc_auc(Clinic(spark, sf_dir).risk_fixture)


@register("quality_gate", f"""
SELECT roc_auc, CASE WHEN roc_auc >= 0.80 THEN 'target achieved (ROC-AUC >= 0.80)'
                     WHEN roc_auc >= 0.75 THEN 'good (ROC-AUC >= 0.75)'
                     WHEN roc_auc >= 0.70 THEN 'decent (ROC-AUC >= 0.70)' ELSE 'still improving' END AS gate
FROM ({_AUC_SQL.replace('WITH per', 'WITH per', 1)})""")
def q_quality_gate(spark, sf_dir):
    return ML.quality_gate(ML.roc_auc(Clinic(spark, sf_dir).risk_fixture))


def _build_risk(c: Clinic, folder: str) -> None:
    """The final risk model on all labelled rows, with these rows and their weights."""
    df = write_version(ML.class_weights(_train_input(c), mode="pos_scale"), f"{folder}/rows")
    ML.save_model(ML.train_gbt_base(df), f"{folder}/model")


def _fitted_gbt(spark, sf_dir: str, rebuild: bool = False):
    """The weighted training rows and the path of the final risk model."""
    folder = _stored(spark, sf_dir, "risk", _build_risk, rebuild)
    return spark.read.parquet(f"{folder}/rows"), f"{folder}/model"


@register("model_store")
def q_model_store(spark, sf_dir):
    """Save the pipeline (features live in its assembler), reload, score."""
    df, path = _fitted_gbt(spark, sf_dir)
    return ML.score(ML.load_model(path), df).select("subject_id", "risk_score", "risk_tier")


@register("shap_values")
def q_shap_values(spark, sf_dir):
    """Log-odds attributions of the risk model for every labelled patient."""
    df, path = _fitted_gbt(spark, sf_dir)
    return SH.shap_values(spark, df, S.BASIC_FEATURES, SH.gbt_stage_path(path, spark),
                          parts=2 * spark.sparkContext.defaultParallelism)


@register("shap_waterfall")
def q_shap_waterfall(spark, sf_dir):
    """From the model's expected log-odds to those of the patient with the highest score, step by step."""
    df, path = _fitted_gbt(spark, sf_dir)
    top = SV.top_patient(ML.score(ML.load_model(path), df)).select("subject_id")
    rows = df.join(F.broadcast(top), "subject_id")
    return SH.waterfall(SH.shap_values(spark, rows, S.BASIC_FEATURES, SH.gbt_stage_path(path, spark)), rows)


@register("shap_top_patient", """
WITH top AS (SELECT subject_id FROM scores ORDER BY risk_score DESC, subject_id LIMIT 1),
vals AS (
  SELECT f.subject_id, 'shap_admission_count' AS feature, CAST(f.admission_count AS DOUBLE) AS feature_value FROM patient_features f
  UNION ALL SELECT subject_id, 'shap_emergency_ratio', emergency_ratio FROM patient_features
  UNION ALL SELECT subject_id, 'shap_days_since_last_admission', COALESCE(days_since_last_admission, -1) FROM patient_features
  UNION ALL SELECT subject_id, 'shap_has_previous_admission', CAST(has_previous_admission AS DOUBLE) FROM patient_features)
SELECT d.subject_id, d.rank, d.feature, v.feature_value, d.value AS shap,
       CASE WHEN d.value > 0 THEN 'increases risk' ELSE 'decreases risk' END AS direction,
       SUM(d.value) OVER (PARTITION BY d.subject_id ORDER BY d.rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         AS cumulative
FROM drivers d JOIN top t ON d.subject_id = t.subject_id
JOIN vals v ON v.subject_id = d.subject_id AND v.feature = d.feature""")
def q_shap_top_patient(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    top = SV.top_patient(c.scores).select("subject_id")
    f = c.base_features
    vals = f.select("subject_id", F.inline(F.array(*[
        F.struct(F.lit(f"shap_{n}").alias("feature"), e.cast("double").alias("feature_value")) for n, e in [
            ("admission_count", F.col("admission_count")), ("emergency_ratio", F.col("emergency_ratio")),
            ("days_since_last_admission", F.coalesce("days_since_last_admission", F.lit(-1.0))),
            ("has_previous_admission", F.col("has_previous_admission"))]])))
    d = SV.rank_drivers(c.shap_fixture).join(top, "subject_id").join(vals, ["subject_id", "feature"])
    w = Window.partitionBy("subject_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("subject_id", "rank", "feature", "feature_value", F.col("value").alias("shap"),
                    F.when(F.col("value") > 0, F.lit("increases risk")).otherwise(F.lit("decreases risk")).alias("direction"),
                    F.sum("value").over(w).alias("cumulative"))
