"""File sources: CSV exports (gzip or plain), required/optional inputs, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carepath.operators.joins import sized_broadcast
from carepath.session import shared_path


class MissingInput(FileNotFoundError):
    pass


def _fs_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem (works for HDFS/S3/local, globs too)."""
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hpath)
    return found is not None and len(found) > 0


def resolve_csv(spark: SparkSession, base: str, name: str) -> str:
    """``NAME.csv.gz`` if present, else ``NAME.csv``, else MissingInput."""
    stem = name[:-len(".csv.gz")] if name.endswith(".csv.gz") else name.removesuffix(".csv")
    for cand in (f"{base.rstrip('/')}/{stem}.csv.gz", f"{base.rstrip('/')}/{stem}.csv"):
        if _fs_exists(spark, cand):
            return cand
    raise MissingInput(f"cannot find {stem}.csv.gz or {stem}.csv in {base}")


def lower_columns(df: DataFrame) -> DataFrame:
    """Normalise header case (exports use SUBJECT_ID, HADM_ID, ...)."""
    return df.toDF(*[c.lower() for c in df.columns])


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             min_partitions: int | None = None, multi_line: bool = False, order: str | None = None) -> DataFrame:
    """Read a CSV export; nothing is inferred.

    Every column is read as text (no inference pass), headers are lower-cased,
    and when ``schema`` is given its columns are picked by name and typed with
    ``try_cast`` (a bad cell becomes null, it does not fail the job). Exports
    carry more columns than used; those are pruned here.
    ``multi_line`` allows quoted line ends (notes); such a file, like any gzip
    file, is read by one task, so the rows are repartitioned right after the
    read. ``order`` names a column for the place of a row: 0, 1, 2, ... through the
    files in order of their names, as one sequential read would number them. For it the
    rows are written to the shared folder once and read from there (see ``_numbered``).
    Convert large exports to Parquet once and read that instead.
    """
    df = (spark.read.option("header", True).option("multiLine", multi_line)
          .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
          .csv(path))
    if order:
        df = df.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK),
                       F.monotonically_increasing_id().alias(_ROW))
    df = lower_columns(df)
    place = [_FILE, _BLOCK, _ROW] if order else []
    if schema is not None:
        df = df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields if f.name != order], *place)
    if order:
        return _numbered(df, order)
    if min_partitions != 0:
        df = df.repartition(min_partitions or spark.sparkContext.defaultParallelism)
    return df


_FILE, _BLOCK, _ROW = "_export_file", "_export_block", "_export_row"


def _numbered(df: DataFrame, order: str) -> DataFrame:
    """Rows with their place over all files instead of (file, block, running id).

    A task numbers the rows of a block one after another, so a row's place in its block is its number less the
    block's first; the blocks before it, in order of file name and offset, add their counts. The numbers hold for one
    read only, hence the written table. There is one row per block (a split of a file), which one task adds up.
    """
    path = shared_path(df.sparkSession, "export")
    df.write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    blocks = rows.groupBy(_FILE, _BLOCK).agg(F.count(F.lit(1)).alias("n"), F.min(_ROW).alias("first"))
    before = Window.orderBy(_FILE, _BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(_FILE, _BLOCK, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(sized_broadcast(starts), [_FILE, _BLOCK]).select(
        *[c for c in rows.columns if c not in (_FILE, _BLOCK, _ROW)], (F.col(_ROW) + F.col("shift")).cast("long").alias(order))


def require_inputs(spark: SparkSession, base: str, required: list[str]) -> dict[str, str]:
    """Resolve every required export; fail listing all missing ones."""
    found, missing = {}, []
    for name in required:
        try:
            found[name] = resolve_csv(spark, base, name)
        except MissingInput:
            missing.append(name)
    if missing:
        raise MissingInput(f"missing required inputs {missing} in {base}")
    return found


def load_optional(spark: SparkSession, base: str, name: str, schema: T.StructType) -> DataFrame:
    """Optional export: an empty frame with the same columns when absent."""
    try:
        return scan_csv(spark, resolve_csv(spark, base, name), schema)
    except MissingInput:
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, query: str | None = None,
               args: dict | None = None) -> DataFrame:
    """A stored table, optionally through a named-parameter SQL query.

    ``query`` refers to the table as ``{t}``; values bind through ``args``
    (``:name`` markers), never by string concatenation.
    """
    df = spark.read.parquet(path)
    if query is None:
        return df
    return spark.sql(query, args=args or {}, t=df)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
              partitions: int, props: dict | None = None) -> DataFrame:
    """A relational-database table read in parallel slices of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=props or {})


def write_csv(df: DataFrame, path: str, compression: str | None = None,
              upper_headers: bool = False) -> None:
    """Write an export-style CSV (header, quoted, whitespace kept)."""
    if upper_headers:
        df = df.toDF(*[c.upper() for c in df.columns])
    w = (df.write.mode("overwrite").option("header", True)
         .option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if compression:
        w = w.option("compression", compression)
    w.csv(path)
