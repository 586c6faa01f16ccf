"""Table sinks and maintenance on Parquet folders.

Plain Parquet has no row-level update, so updates are written the Spark way:
join the old version with the change set on the key, resolve each column with
``coalesce``, write a new version. Every write goes to a folder under the
shared checkpoint root (or a caller-given shared path), never a machine-local
one, so a lost executor's work is recomputed from lineage or re-read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append_table(df: DataFrame, path: str, max_records_per_file: int | None = None) -> None:
    """Append rows. Batching is per task/file (``maxRecordsPerFile``), not a row loop."""
    w = df.write.mode("append")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.parquet(path)


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace the whole table (a new version of every file)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def clear_tables(spark: SparkSession, tables: dict[str, tuple[str, T.StructType]]) -> None:
    """Empty each table, child tables first (dict order is the delete order)."""
    for _name, (path, schema) in tables.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def evolve_columns(df: DataFrame, added: dict[str, T.DataType], default=0) -> DataFrame:
    """Add each missing column with a typed default; existing ones are untouched (idempotent)."""
    for name, dtype in added.items():
        if name not in df.columns:
            value = F.lit(None) if default is None else F.lit(default)
            df = df.withColumn(name, value.cast(dtype))
    return df


def update_by_key(target: DataFrame, changes: DataFrame, key: str | list[str],
                  columns: list[str]) -> DataFrame:
    """``UPDATE target SET columns = changes.columns WHERE key matches``.

    Unmatched target rows are unchanged; change rows without a target row
    are ignored (left join). Null in the change set keeps the old value.
    A change key that is repeated fails the job instead of repeating target rows. ``sources.keyed``
    has the form that updates a stored table in place.
    """
    keys = [key] if isinstance(key, str) else list(key)
    # grouping by the join's own key: no further shuffle
    ch = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times"), *[F.any_value(c).alias(f"_new_{c}") for c in columns])
    j = target.join(ch, keys, "left")
    types = dict(target.dtypes)
    refused = F.raise_error(F.lit(f"a change repeats its key ({', '.join(keys)})"))

    def new(c: str) -> Column:
        kept = F.coalesce(F.col(f"_new_{c}"), F.col(c)).cast(types[c])
        return F.when(F.col("_times") > 1, refused.cast(types[c])).otherwise(kept).alias(c)
    return j.select(*[new(c) if c in columns else F.col(c) for c in target.columns])


def upsert(target: DataFrame, source: DataFrame, key: str | list[str], columns: list[str],
           defaults: dict[str, object] | None = None) -> DataFrame:
    """``INSERT ... ON CONFLICT (key) DO UPDATE SET columns``.

    Full outer join on the key: matched rows take ``columns`` from source and
    keep every other column; new keys get source values and ``defaults`` (or
    null) for the rest; target-only rows are unchanged.
    """
    keys = [key] if isinstance(key, str) else list(key)
    defaults = defaults or {}
    src = source.select(*keys, *[F.col(c).alias(f"_src_{c}") for c in columns],
                        F.lit(True).alias("_in_src"))
    tgt = target.withColumn("_in_tgt", F.lit(True))
    j = tgt.join(src, keys, "full_outer")
    types = dict(target.dtypes)
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in columns:
            out.append(F.when(F.col("_in_src"), F.col(f"_src_{c}")).otherwise(F.col(c))
                        .cast(types[c]).alias(c))
        else:
            d = defaults.get(c)
            fill = F.lit(d).cast(types[c]) if d is not None else F.lit(None).cast(types[c])
            out.append(F.when(F.col("_in_tgt"), F.col(c)).otherwise(fill).alias(c))
    return j.select(*out)


def check_unique_key(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Primary-key violations: duplicate or null keys with their row counts (empty = valid)."""
    keys = [key] if isinstance(key, str) else list(key)
    null_key = None
    for k in keys:
        null_key = F.col(k).isNull() if null_key is None else null_key | F.col(k).isNull()
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
              .filter((F.col("n_rows") > 1) | null_key))


def load_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) for each table, as one distributed union of counts."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_lookup(df: DataFrame, path: str, key: str, distinct_keys: int = 1_000_000) -> None:
    """Write a table for reads by single keys: files and row groups hold neighbouring keys, whose minima and maxima
    rule most of them out, and a Bloom filter on the key rules out others that span it (``distinct_keys`` a file)."""
    (df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite")
     .option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct_keys)).parquet(path))


def write_version(df: DataFrame, path: str) -> DataFrame:
    """Write a table version and return it re-read (cuts lineage; survives executor loss)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
