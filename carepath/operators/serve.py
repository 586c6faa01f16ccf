"""Serving tables: tiers, dashboard aggregates, top-k lists, drivers, profiles, reports.

Everything aggregates on executors; only result rows (a top-k, ten histogram
buckets, one stats row) are small enough to reach a client.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath import schemas as S
from carepath.functions import scalar as X
from carepath.functions.predicates import filter_tier

PROFILE_FEATURES = ["age", "charlson_score", "num_diagnoses", "num_icu_stays", "total_icu_hours", "had_icu"]


# ------------------------------------------------------------------ joins
def join_scores_features(scores: DataFrame, features: DataFrame) -> DataFrame:
    """Inner equi-join on subject_id (AQE picks broadcast or sort-merge at run time)."""
    return scores.join(features, "subject_id", "inner")


def patient_profile(scores: DataFrame, features: DataFrame) -> DataFrame:
    """The 15-column risk + feature row per patient."""
    j = join_scores_features(scores, features)
    return j.select(
        "subject_id", "risk_score", "risk_tier", "predicted_ward", "estimated_los_days",
        "admission_count", "emergency_ratio", "avg_los_days",
        X.default_recency().alias("days_since_last_admission"),
        *[X.default_zero(c).cast(S.ADDED_FEATURE_TYPES[c]).alias(c) for c in PROFILE_FEATURES])


def point_lookup(requests: DataFrame, table: DataFrame, key: str = "subject_id", max_ids: int = 1000) -> DataFrame:
    """Batch form of ``WHERE key = :id LIMIT 1``: one row per requested key, ``found`` flag.

    Up to ``max_ids`` requested keys become a list in the table's scan, which skips files and row groups by their
    minima, maxima and Bloom filters (see ``write_lookup``); with more, a semi join leaves the requested rows.
    Only these are reduced to one row per key (the LIMIT 1). Missing ids come back as not found.
    """
    asked = requests.select(key).distinct()
    ids = [r[0] for r in asked.limit(max_ids + 1).collect()]
    if len(ids) <= max_ids:
        rows = table.where(F.col(key).isin(sorted(i for i in ids if i is not None)))
    else:
        rows = table.join(asked, key, "left_semi")
    one = rows.groupBy(key).agg(F.min(F.struct(*[c for c in table.columns if c != key])).alias("_r"))
    j = asked.join(one, key, "left")
    return j.select(key, F.col("_r").isNotNull().alias("found"),
                    *[F.col(f"_r.{c}").alias(c) for c in table.columns if c != key])


# ---------------------------------------------------------------- top-k
def list_patients(scores: DataFrame, features: DataFrame, limit: int = 100,
                  tier: str | None = None) -> DataFrame:
    """Distinct patient rows, optional tier, highest score first (ties by id), top ``limit``."""
    rows = (join_scores_features(scores, features)
            .select("subject_id", "risk_score", "risk_tier", "admission_count", "emergency_ratio")
            .distinct())
    rows = filter_tier(rows, tier)
    return rows.orderBy(F.desc("risk_score"), F.asc("subject_id")).limit(limit)


def list_patients_by_tier(scores: DataFrame, features: DataFrame, per_tier: int = 500) -> DataFrame:
    """Top ``per_tier`` per tier in one job (window with a per-map-task group limit)."""
    rows = (join_scores_features(scores, features)
            .select("subject_id", "risk_score", "risk_tier", "admission_count", "emergency_ratio")
            .filter(F.col("risk_tier").isin(*S.TIERS)))
    w = Window.partitionBy("risk_tier").orderBy(F.desc("risk_score"), F.asc("subject_id"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_tier)


def top_k(df: DataFrame, k: int, cols: list[str], score: str = "risk_score") -> DataFrame:
    return df.select(*cols).orderBy(F.desc(score), F.asc("subject_id")).limit(k)


def top_patient(scores: DataFrame) -> DataFrame:
    """Highest score (lowest id on ties) as one partial-aggregated max_by."""
    best = F.max_by(F.struct("subject_id", "risk_score"),
                    F.struct(F.col("risk_score"), (-F.col("subject_id")).alias("neg_id")))
    return scores.agg(best.alias("t")).select("t.subject_id", "t.risk_score").filter(F.col("subject_id").isNotNull())


# ----------------------------------------------------------- aggregates
def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per non-null value, largest first."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), F.asc(col)))


def dashboard_stats(rows: DataFrame) -> DataFrame:
    """Totals per tier and mean score in percent (one dp, as the dashboard prints it), one row."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("risk_tier") == "HIGH").alias("n_high"),
        F.count_if(F.col("risk_tier") == "MEDIUM").alias("n_medium"),
        F.count_if(F.col("risk_tier") == "LOW").alias("n_low"),
        X.fmt_browser(F.avg("risk_score") * F.lit(100.0), 1).alias("avg_score_pct"),
    )


def score_histogram(spark, scores: DataFrame) -> DataFrame:
    """Ten equal-width buckets over [0, 1], empty buckets included."""
    counts = (scores.filter(F.col("risk_score").isNotNull())
              .groupBy(X.score_bucket("risk_score").alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
    buckets = spark.range(10).select(F.col("id").cast("int").alias("bucket"))
    return (F.broadcast(buckets).join(counts, "bucket", "left")
            .select("bucket", F.coalesce("n", F.lit(0)).alias("n"),
                    X.risk_band(F.col("bucket") / F.lit(10.0)).alias("band")))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per column (long form, one row per column).

    Quartiles are exact (linear interpolation between order statistics, see ``order_statistics``), whatever
    the number of distinct values.
    """
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in cols])))
    stats = long.groupBy("feature").agg(
        F.count("v").alias("count"), X.stable(F.avg("v")).alias("mean"), X.stable(F.stddev_samp("v")).alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    found = [(c, *q) for c, q in quantiles(wide, cols, (0.25, 0.5, 0.75)).items()]
    q = df.sparkSession.createDataFrame(found, "feature string, q25 double, q50 double, q75 double")   # one row a column
    return stats.join(F.broadcast(q), "feature").select("feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def quantiles(df: DataFrame, cols: list[str], shares: tuple[float, ...]) -> dict[str, list[float | None]]:
    """Exact quantiles of each double column, linear between neighbouring order statistics; nulls left out."""
    n = df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    at = {c: [share * (n[c] - 1) for share in shares] if n[c] else [] for c in cols}
    ranks = {c: sorted({r for x in at[c] for r in (math.floor(x), math.ceil(x))}) for c in cols}
    value = order_statistics(df, ranks)
    out: dict[str, list[float | None]] = {}
    for c in cols:
        out[c] = [value[c, math.floor(x)] + (x - math.floor(x)) * (value[c, math.ceil(x)] - value[c, math.floor(x)])
                  for x in at[c]] or [None] * len(shares)
    return out


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], buckets: int = 1024) -> dict[tuple[str, int], float]:
    """The values with the given 0-based ranks of each double column, by histogram passes.

    A pass counts the rows of all open stretches in ``buckets`` equal parts and notes each part's least and greatest
    value; a rank's next stretch is the part it falls into, from that least to that greatest value. Both ends of a stretch
    lie in different parts, so stretches shrink until one is a single value. The driver sees parts, never rows:
    one pass per factor of ``buckets`` in the number of rows for evenly spread values, a few more for others.
    """
    done: dict[tuple[str, int], float] = {}
    ends = df.agg(*[f(c).alias(f"{c}_{name}") for c in ranks for name, f in (("lo", F.min), ("hi", F.max))]).first()
    # a stretch (column, least, greatest) -> the ranks that are looked for in it, counted from its start
    open_ = {(c, ends[f"{c}_lo"], ends[f"{c}_hi"]): [(r, r) for r in rs] for c, rs in ranks.items() if rs}
    while open_:
        for (c, lo, hi), looked in list(open_.items()):
            if lo == hi:
                done |= {(c, r): lo for r, _ in looked}
                del open_[c, lo, hi]
        if not open_:
            break
        keys = list(open_)
        items = []
        for i, (c, lo, hi) in enumerate(keys):
            # quarters: the difference of two doubles may be beyond a double
            share = (F.col(c) / 4 - lo / 4) / (hi / 4 - lo / 4)
            part = F.least(F.lit(buckets - 1), F.floor(share * buckets)).cast("int")
            items.append(F.when(F.col(c).between(lo, hi), F.struct(F.lit(i).alias("i"), part.alias("p"), F.col(c).alias("v"))))
        counted = (df.select(F.inline(F.filter(F.array(*items), lambda x: x.isNotNull()))).groupBy("i", "p")
                   .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i", "p").collect())
        parts: dict[int, list] = {}
        for row in counted:
            parts.setdefault(row.i, []).append(row)
        narrowed: dict[tuple, list] = {}
        for i, key in enumerate(keys):
            for r, left in open_[key]:
                for row in parts[i]:
                    if left < row.n:
                        narrowed.setdefault((key[0], row.lo, row.hi), []).append((r, left))
                        break
                    left -= row.n
        open_ = narrowed
    return done


def class_balance(df: DataFrame, label: str = "high_risk_label") -> DataFrame:
    """neg, pos and the neg/pos weight (1.0 when there are no positives)."""
    out = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos"))
    return out.withColumn("scale_pos_weight", F.when(F.col("pos") > 0, F.col("neg") / F.col("pos"))
                          .otherwise(F.lit(1.0)))


# ---------------------------------------------------------- attributions
def shap_long(shap: DataFrame, key: str = "subject_id") -> DataFrame:
    """Wide attribution row -> (subject_id, feature, position, value)."""
    feats = [c for c in shap.columns if c.startswith("shap_")]
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"),
                               F.col(c).cast("double").alias("value")) for i, c in enumerate(feats)])
    return shap.select(key, F.inline(items))


def ranked_drivers(shap: DataFrame) -> Column:
    """A row's attributions as an array of (feature, position, value), |value| desc, feature order on ties.

    The row holds every attribution of its patient, so ranking is a sort inside the row: no
    shuffle and no window. Missing values come last.
    """
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), F.col(c).cast("double").alias("value"))
                      for i, c in enumerate(c for c in shap.columns if c.startswith("shap_"))])

    def earlier(a: Column, b: Column) -> Column:
        x, y = (F.coalesce(F.abs(s["value"]), F.lit(-1.0)) for s in (a, b))
        return F.when(x > y, -1).when(x < y, 1).otherwise(a["position"] - b["position"])
    return F.array_sort(items, earlier)


def rank_drivers(shap: DataFrame) -> DataFrame:
    """(subject_id, feature, position, value, rank): one row per attribution, in the order of ``ranked_drivers``."""
    ranked = F.transform(ranked_drivers(shap), lambda x, i: F.struct(
        x["feature"].alias("feature"), x["position"].alias("position"), x["value"].alias("value"), (i + 1).alias("rank")))
    return shap.select("subject_id", F.inline(ranked))


def top_drivers(shap: DataFrame, k: int = 3) -> DataFrame:
    return rank_drivers(shap).filter(F.col("rank") <= k)


def shap_global(shap: DataFrame) -> DataFrame:
    """Mean |attribution| per feature (global importance)."""
    return (shap_long(shap).groupBy("feature", "position")
            .agg(X.stable(F.avg(F.abs("value"))).alias("mean_abs_shap")).drop("position"))


def report_drivers(drivers: Column) -> Column:
    """Report table lines of ranked drivers: readable name, |impact| to 4 dp, direction."""
    return F.transform(drivers, lambda x, i: F.struct(
        (i + 1).alias("rank"), X.driver_name(x["feature"]).alias("feature_name"),
        X.fmt_fixed(F.abs(x["value"]), 4).alias("impact"),
        X.driver_direction(x["value"], "↑ Increases Risk", "↓ Decreases Risk").alias("direction")))


def report_driver_rows(shap: DataFrame) -> DataFrame:
    return shap.select("subject_id", F.inline(report_drivers(ranked_drivers(shap))))


# The report's summary fields.
REPORT_FIELDS = ["Patient ID", "Risk Score", "Risk Tier", "Assigned Ward", "Est. Stay",
                 "Admissions", "Emergency Rate", "Avg Stay"]


def report_summary() -> Column:
    """Eight (position, field, value) entries of a profile row for the report's summary table."""
    vals = [
        F.col("subject_id").cast("string"),
        X.fmt_percent(F.coalesce("risk_score", F.lit(0.0))),
        F.coalesce("risk_tier", F.lit("N/A")),
        F.coalesce("predicted_ward", F.lit("N/A")),
        F.concat(X.fmt_fixed(F.coalesce("estimated_los_days", F.lit(0.0)), 1), F.lit(" days")),
        F.coalesce("admission_count", F.lit(0)).cast("long").cast("string"),
        X.fmt_percent(F.coalesce("emergency_ratio", F.lit(0.0))),
        F.concat(X.fmt_fixed(F.coalesce("avg_los_days", F.lit(0.0)), 1), F.lit(" days")),
    ]
    return F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("field"), v.alias("value"))
                     for i, (name, v) in enumerate(zip(REPORT_FIELDS, vals, strict=True))])


def report_summary_rows(profile: DataFrame) -> DataFrame:
    return profile.select("subject_id", F.inline(report_summary()))


def ward_summary(profile: DataFrame) -> DataFrame:
    return profile.select("subject_id", "risk_score", "risk_tier", "predicted_ward", "estimated_los_days")
