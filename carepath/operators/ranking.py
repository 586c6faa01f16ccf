"""Exact global ranks and prefix sums without a single-partition window.

``row_number().over(Window.orderBy(x))`` (no partitionBy) moves every row
into one task. Here rows are range-partitioned on the order, each partition
is ranked on its own (a bounded window), and per-partition totals — one
number per partition — become offsets. This is ``zipWithIndex`` written with
DataFrames. The range-partitioned table is checkpointed first so partition
ids stay fixed while offsets are computed (and lineage is cut).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carepath.operators.joins import sized_broadcast


def _partitioned(df: DataFrame, by: list[str], order: list[str], parts: int | None) -> DataFrame:
    from carepath.session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    r = df.repartitionByRange(n, *[F.col(c) for c in by + order]).withColumn("_pid", F.spark_partition_id())
    return r.checkpoint(eager=True)


def rank_within(df: DataFrame, by: list[str], order: list[str], parts: int | None = None,
                name: str = "rank") -> DataFrame:
    """0-based rank of each row inside its ``by`` group, in ``order`` (ties broken by order cols)."""
    spark = df.sparkSession
    r = _partitioned(df, by, order, parts)
    counts = r.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # offsets: one row per (partition, group) — bounded by partitions x groups
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w_off), F.lit(0))).drop("_n")
    w = Window.partitionBy("_pid", *by).orderBy(*order)
    out = r.join(sized_broadcast(offsets), ["_pid", *by])
    return out.withColumn(name, (F.col("_off") + F.row_number().over(w) - 1).cast("long")).drop("_pid", "_off")


def prefix_sum(df: DataFrame, order: str, value: str, parts: int | None = None,
               name: str = "cum") -> DataFrame:
    """Sum of ``value`` over all rows strictly before each row in ``order`` (order unique)."""
    r = _partitioned(df, [], [order], parts)
    totals = r.groupBy("_pid").agg(F.sum(value).alias("_t"))
    w_off = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(w_off), F.lit(0))).drop("_t")
    w = Window.partitionBy("_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = r.join(sized_broadcast(offsets), "_pid")
    return out.withColumn(name, F.col("_off") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("_pid", "_off")
