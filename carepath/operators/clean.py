"""Cleaning: projection, parsing, first-row dedup, referential filters, note limit.

Ordering follows the load the cleaned tables stand for: admissions are
restricted to known patients *before* duplicate admissions are dropped, and
notes are limited *before* rows without text are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.functions import scalar as X
from carepath.sources.files import lower_columns

NOTES_LIMIT = 50_000


def dedup_first(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """Keep the first row per key by ``order`` (file order), deterministically.

    Written as ``min(struct(order..., rest...))`` per key: a declarative
    aggregate, so each map task collapses its copies of a key before the
    shuffle. A key holding a third of all rows costs one row per map task,
    not one giant sorted window partition.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order_cols = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys and c not in order_cols]
    packed = F.struct(*[F.col(c) for c in order_cols + rest]).alias("_first")
    return (df.groupBy(*keys).agg(F.min(packed).alias("_first"))
              .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order_cols + rest])
              .select(*df.columns))


def project_patients(raw: DataFrame) -> DataFrame:
    raw = lower_columns(raw)
    keep = [c for c in ("seq",) if c in raw.columns]
    return raw.select(*keep, F.col("subject_id").cast("long").alias("subject_id"),
                      F.col("gender").cast("string").alias("gender"),
                      X.safe_parse_date("dob").alias("dob"))


def project_admissions(raw: DataFrame) -> DataFrame:
    raw = lower_columns(raw)
    keep = [c for c in ("seq",) if c in raw.columns]
    return raw.select(*keep, F.col("hadm_id").cast("long").alias("hadm_id"),
                      F.col("subject_id").cast("long").alias("subject_id"),
                      X.safe_parse_ts("admittime").alias("admittime"),
                      X.safe_parse_ts("dischtime").alias("dischtime"),
                      F.col("admission_type").cast("string").alias("admission_type"))


def project_notes(raw: DataFrame) -> DataFrame:
    raw = lower_columns(raw)
    if "note_id" not in raw.columns and "seq" in raw.columns:
        raw = raw.withColumn("note_id", F.col("seq"))      # an export names no note: its place does
    keep = [c for c in ("seq", "note_id") if c in raw.columns]
    # a missing category *column* reads as "Unknown"; a null value stays null
    category = F.col("category").cast("string") if "category" in raw.columns else F.lit("Unknown")
    return raw.select(*keep, F.col("subject_id").cast("long").alias("subject_id"),
                      F.col("hadm_id").cast("long").alias("hadm_id"),
                      X.safe_parse_ts("charttime").alias("charttime"),
                      category.alias("category"),
                      F.col("text").cast("string").alias("text"))


def clean_patients(raw: DataFrame) -> DataFrame:
    """Parsed patients, first row per subject_id."""
    return dedup_first(project_patients(raw), "subject_id", "seq").drop("seq")


def semi_valid_subjects(admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """Admissions of known patients only (left semi join: ids never leave the cluster)."""
    return admissions.join(patients.select("subject_id"), "subject_id", "left_semi")


def clean_admissions(raw: DataFrame, patients: DataFrame) -> DataFrame:
    """Known-patient admissions, parsed, first row per hadm_id."""
    known = semi_valid_subjects(lower_columns(raw), patients)
    return dedup_first(project_admissions(known), "hadm_id", "seq").drop("seq")


def semi_valid_notes(notes: DataFrame, patients: DataFrame, admissions: DataFrame) -> DataFrame:
    """Two independent semi joins (subject, then admission); null hadm_id drops."""
    notes = notes.join(patients.select("subject_id"), "subject_id", "left_semi")
    return notes.join(admissions.select("hadm_id"), "hadm_id", "left_semi")


def first_n_by(df: DataFrame, order: str, n: int | None, buckets: int = 1024,
               exact_rows: int = 1_000_000) -> DataFrame:
    """The first ``n`` rows by a long ``order`` column (file order), exactly.

    A plain ``orderBy().limit(n)`` funnels ``n`` rows from *every* partition
    into one task. Instead a few histogram passes over the order column narrow
    the cut to one bucket holding at most ``exact_rows`` rows; everything
    before the bucket is kept by a pushed-down filter, and only that bucket
    goes through a bounded top-k. The driver only ever sees bucket counts.
    """
    if n is None:
        return df
    o = F.col(order)
    st = df.agg(F.count(F.lit(1)).alias("rows"), F.count(o).alias("n"), F.min(o).alias("lo"), F.max(o).alias("hi")).first()
    if st["rows"] <= n:
        return df
    tiebreak = [c for c, t in df.dtypes if c != order and not t.startswith(("array", "map", "struct", "binary"))]
    if st["n"] <= n:      # rows without an order value come last
        ordered, unordered = df.filter(o.isNotNull()), df.filter(o.isNull())
        return ordered if st["n"] == n else ordered.unionByName(unordered.orderBy(*tiebreak).limit(n - st["n"]))
    lo, hi, before = int(st["lo"]), int(st["hi"]), 0
    while True:
        width = max(1, math.ceil((hi - lo + 1) / buckets))
        hist = (df.filter(o.between(lo, hi))
                  .groupBy(F.floor((o - F.lit(lo)) / F.lit(width)).alias("b")).count()
                  .orderBy("b").collect())
        cum = before
        for row in hist:
            if cum + row["count"] >= n:
                b, in_bucket = int(row["b"]), int(row["count"])
                break
            cum += row["count"]
        new_lo = lo + b * width
        new_hi = min(hi, new_lo + width - 1)
        before = cum
        if in_bucket <= exact_rows or width == 1:
            break
        lo, hi = new_lo, new_hi
    head = df.filter(o < F.lit(new_lo))
    if n - before <= 0:
        return head
    # a total order inside the cut bucket: ties on the order column fall back to the other columns
    cut = df.filter(o.between(new_lo, new_hi)).orderBy(o, *tiebreak)
    return head.unionByName(cut.limit(n - before))


def limit_notes(notes: DataFrame, n: int | None = NOTES_LIMIT, order: str = "seq") -> DataFrame:
    """First ``n`` notes in file order: the load's memory cap, for callers that want one."""
    return first_n_by(notes, order, n)


def drop_null_text(notes: DataFrame) -> DataFrame:
    return notes.dropna(subset=["text"])


def clean_notes(raw: DataFrame, patients: DataFrame, admissions: DataFrame,
                limit: int | None = None) -> DataFrame:
    """Notes of known patients and admissions with text; all of them unless a ``limit`` is asked for."""
    valid = semi_valid_notes(lower_columns(raw), patients, admissions)
    return drop_null_text(project_notes(limit_notes(valid, limit)))
