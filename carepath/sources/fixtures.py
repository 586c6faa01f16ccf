"""Raw clinical tables derived from the shared test tables.

The production inputs are clinical CSV exports; for tests and benches they are
derived deterministically from the TPC-H-style tables (customer, orders,
lineitem, events, documents, embeddings, conversations) with the dirt the
cleaning steps exist for: unparsable dates, duplicate keys, orphan rows,
padded codes, null text. ``seq`` stands for file row order. The same rules are
written as SQL in ``carepath.plans.oracle`` for the DuckDB side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORPHAN_SUBJECT = 999_999_999


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mod(c: str, m: int) -> Column:
    return F.col(c) % F.lit(m)


def patients_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    dob = F.make_date((F.lit(1900) + _mod("c_custkey", 90)).cast("int"),
                      (F.lit(1) + _mod("c_custkey", 12)).cast("int"),
                      (F.lit(1) + _mod("c_custkey", 28)).cast("int")).cast("string")
    base = c.select(
        F.lit(0).alias("seq"),
        F.col("c_custkey").alias("subject_id"),
        F.when(_mod("c_custkey", 29) == 0, F.lit(None).cast("string"))
         .when(_mod("c_custkey", 2) == 0, F.lit("M")).otherwise(F.lit("F")).alias("gender"),
        F.when(_mod("c_custkey", 61) == 0, F.lit("not-a-date")).otherwise(dob).alias("dob"),
    )
    dups = c.filter(_mod("c_custkey", 41) == 0).select(
        F.lit(1).alias("seq"), F.col("c_custkey").alias("subject_id"),
        F.lit("F").alias("gender"), F.lit("1950-01-01").alias("dob"))
    return base.unionByName(dups)


def admissions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    hours = (F.lit(6) + (F.col("o_orderkey") * 37) % 300).cast("int")
    disch = (F.col("o_orderdate") + F.make_dt_interval(hours=hours)).cast("string")
    pr = F.col("o_orderpriority")
    base = o.select(
        F.lit(0).alias("seq"),
        F.col("o_orderkey").alias("hadm_id"),
        F.when(_mod("o_orderkey", 101) == 0, F.lit(ORPHAN_SUBJECT).cast("long"))
         .otherwise(F.col("o_custkey")).alias("subject_id"),
        F.col("o_orderdate").cast("string").alias("admittime"),
        F.when(_mod("o_orderkey", 97) == 0, F.lit("bad")).otherwise(disch).alias("dischtime"),
        F.when(pr.isin("1-URGENT", "2-HIGH"), F.lit("EMERGENCY"))
         .when(pr == "3-MEDIUM", F.lit("URGENT"))
         .when(pr == "5-LOW", F.lit("ELECTIVE")).otherwise(F.lit("NEWBORN")).alias("admission_type"),
    )
    dups = o.filter(_mod("o_orderkey", 89) == 0).select(
        F.lit(1).alias("seq"), F.col("o_orderkey").alias("hadm_id"),
        F.col("o_custkey").alias("subject_id"),
        F.lit("2001-12-01 00:00:00").alias("admittime"),
        F.lit("2001-12-31 00:00:00").alias("dischtime"),
        F.lit("EMERGENCY").alias("admission_type"))
    return base.unionByName(dups)


def diagnoses_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    code = F.concat(F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"),
                    F.col("l_linenumber").cast("string"))
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .select(F.col("o_custkey").alias("subject_id"),
                      F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
                       .when(_mod("l_orderkey", 11) == 0, F.concat(F.lit(" "), code))
                       .otherwise(code).alias("icd9_code")))


def icustays_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return (ev.filter((F.col("event_type") == "error") & (_mod("event_id", 5) == 0))
              .select(F.when(_mod("event_id", 71) == 0, F.lit(None).cast("long"))
                       .otherwise(F.col("event_id")).alias("icustay_id"),
                      F.col("user_id").alias("subject_id"),
                      F.when(_mod("event_id", 83) == 0, F.lit(None).cast("double"))
                       .otherwise(F.col("value") / F.lit(24.0)).alias("los")))


def notes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    start = F.expr("TIMESTAMP_NTZ '2001-01-01 00:00:00'")
    k = F.col("doc_id")
    return d.select(
        k.alias("seq"), k.alias("note_id"),
        F.when(_mod("doc_id", 13) == 0, F.lit(ORPHAN_SUBJECT).cast("long"))
         .otherwise(k % 97).alias("subject_id"),
        F.when(_mod("doc_id", 17) == 0, F.lit(None).cast("long")).otherwise(k * 3).alias("hadm_id"),
        (start + F.make_dt_interval(hours=k.cast("int"))).cast("string").alias("charttime"),
        F.when(_mod("doc_id", 3) == 0, F.lit("Nursing"))
         .when(_mod("doc_id", 3) == 1, F.lit("Physician")).otherwise(F.lit("Radiology")).alias("category"),
        F.when(_mod("doc_id", 19) == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("text"),
    )


def note_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("note_id"), F.col("label").cast("long").alias("subject_id"),
                    "embedding")


def questions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doctor questions: user turns of the conversation table, one patient per conversation."""
    c = table(spark, sf_dir, "conversations")
    return (c.filter(F.col("role") == "user")
             .select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"),
                     (F.col("conv_id") % 97).alias("subject_id"),
                     F.col("text").alias("question")))


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    ck = F.col("c_custkey")
    return c.select(
        ck.alias("subject_id"),
        ((ck * 37) % 101 / F.lit(100.0)).alias("risk_score"),
        F.when(ck % 3 == 0, F.lit(1)).otherwise(F.lit(0)).alias("label"),
        F.when(ck % 5 == 0, F.lit(None).cast("string"))
         .when(ck % 4 == 0, F.lit("ICU")).when(ck % 4 == 1, F.lit("MICU"))
         .when(ck % 4 == 2, F.lit("Private")).otherwise(F.lit("General")).alias("predicted_ward"),
    )


SHAP_FIXTURE_COLUMNS = {
    # column: (multiplier, modulus, offset)
    "shap_admission_count": (13, 41, 20),
    "shap_emergency_ratio": (17, 31, 15),
    "shap_days_since_last_admission": (19, 29, 14),
    "shap_has_previous_admission": (23, 11, 5),
}


def shap_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey").filter(F.col("c_custkey") % 43 != 0)
    ck = F.col("c_custkey")
    cols = [((ck * m) % n - off) / F.lit(10.0) for (m, n, off) in SHAP_FIXTURE_COLUMNS.values()]
    return c.select(ck.alias("subject_id"),
                    *[col.alias(name) for col, name in zip(cols, SHAP_FIXTURE_COLUMNS)])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
