"""Hot keys: one patient with a third of all admissions, one admission id copied a
third of the time. AQE skew splitting is forced on at local sizes; results must equal
a brute-force computation."""

import pandas as pd
from pyspark.sql import functions as F

from carepath.operators import clean, features as FE
from carepath.plans.context import Clinic
from conftest import SF_CHECK

HOT_SUBJECT = 7
HOT_HADM = 123456789


def _skewed(c):
    raw = c.admissions_raw
    hot_subject = F.when(F.col("hadm_id") % 3 == 0, F.lit(HOT_SUBJECT).cast("long")).otherwise(F.col("subject_id"))
    hot_hadm = F.when(F.col("hadm_id") % 3 == 1, F.lit(HOT_HADM).cast("long")).otherwise(F.col("hadm_id"))
    # file order is kept in seq: copies of the hot admission id keep their original order key
    return raw.select((F.col("hadm_id") * 2 + F.col("seq")).alias("seq"), hot_hadm.alias("hadm_id"),
                      hot_subject.alias("subject_id"), "admittime", "dischtime", "admission_type")


def test_hot_keys_match_brute_force(spark):
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        c = Clinic(spark, SF_CHECK)
        raw = _skewed(c)
        adm = clean.clean_admissions(raw, c.patients)
        got = FE.patient_features(c.patients, adm).toPandas().set_index("subject_id").sort_index()
        pdf = raw.toPandas()
        pats = set(r.subject_id for r in c.patients.select("subject_id").collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)

    # brute force: known patients, parse, first row per hadm_id by seq, complete stays
    a = pdf[pdf.subject_id.isin(pats)].copy()
    a["admit"] = pd.to_datetime(a.admittime, errors="coerce", format="%Y-%m-%d %H:%M:%S")
    a["disch"] = pd.to_datetime(a.dischtime, errors="coerce", format="%Y-%m-%d %H:%M:%S")
    a = a.sort_values("seq").drop_duplicates("hadm_id", keep="first")
    a = a.dropna(subset=["admit", "disch"])
    a["us"] = (a.disch - a.admit) // pd.Timedelta(microseconds=1)
    g = a.groupby("subject_id")
    want = pd.DataFrame({
        "admission_count": g.hadm_id.count(),
        "max_los_days": g.us.max() / 86_400_000_000,
        "high_risk_label": (g.us.sum() > g.us.count() * 561_600_000_000).astype(int),
    }).sort_index()
    assert (got.loc[HOT_SUBJECT, "admission_count"]) == want.loc[HOT_SUBJECT, "admission_count"]
    assert got.loc[HOT_SUBJECT, "admission_count"] > len(pdf) // 10
    assert list(got.index) == list(want.index)
    assert (got.admission_count == want.admission_count).all()
    assert (got.high_risk_label == want.high_risk_label).all()
    assert ((got.max_los_days - want.max_los_days).abs() < 1e-9).all()
