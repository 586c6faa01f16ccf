"""A stored table that is updated by key, rewriting only the parts that change.

Rows are dealt into buckets by the key's hash; each bucket is a folder. An update writes new folders
for the buckets that hold a changed key and nothing else, then appends one file of (version, bucket,
folder) rows to the table's log. That append is the commit: a reader takes each bucket's folder of
the greatest version, so it sees all of an update or nothing of it, and readers of the version
before keep their files. What passes through the driver is the log: one row per bucket and update that
touched it. One writer at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.sources.tables import check_unique_key, update_by_key

LOG = "version long, bucket int, folder string"


class RepeatedKey(ValueError):
    """A change set names a key more than once, or a null key."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int = 64) -> KeyedTable:
        out = cls(df.sparkSession, path, key, buckets)
        out._commit(1, out._write(df), list(range(buckets)))
        df.limit(0).write.mode("overwrite").parquet(f"{out.path}/schema")
        return out

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> str:
        folder = f"{self.path}/data-{uuid.uuid4().hex[:12]}"
        # by range, so that a large bucket is several tasks and files
        rows.withColumn("bucket", self._bucket()).repartitionByRange("bucket", self.key) \
            .sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(folder)
        return folder

    def _commit(self, version: int, folder: str, buckets: list[int]) -> None:
        rows = self.spark.createDataFrame([(version, b, folder) for b in buckets], LOG)
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    def version(self) -> int:
        return self._log().agg(F.max("version")).first()[0]

    def folders(self, version: int | None = None) -> dict[int, str]:
        """Bucket -> folder of the given (or latest) version."""
        log = self._log() if version is None else self._log().where(F.col("version") <= version)
        rows = log.groupBy("bucket").agg(F.max_by("folder", "version").alias("folder")).collect()
        return {r.bucket: r.folder for r in rows}

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets, at a version."""
        by_folder: dict[str, list[int]] = {}
        for b, folder in self.folders(version).items():
            if buckets is None or b in buckets:
                by_folder.setdefault(folder, []).append(b)
        schema = self.spark.read.parquet(f"{self.path}/schema").schema.add("bucket", "integer")
        parts = [self.spark.read.schema(schema).parquet(folder).where(F.col("bucket").isin(some)).drop("bucket")
                 for folder, some in by_folder.items()]
        return reduce(DataFrame.unionByName, parts)

    def update(self, changes: DataFrame, columns: list[str]) -> int:
        """``UPDATE ... SET columns WHERE key matches``; the number of buckets that were rewritten.

        A null in the changes keeps the old value, a key without a row is ignored, a repeated key is refused.
        """
        if not check_unique_key(changes, self.key).isEmpty():
            raise RepeatedKey(f"the changes have repeated or null values of {self.key}")
        named = changes.select(self._bucket().alias("b")).distinct().collect()         # at most one row per bucket
        target = self.read(buckets=[r.b for r in named]) if named else None
        if target is None:
            return 0
        held = target.select(self.key).join(changes.select(self.key), self.key, "left_semi")
        touched = sorted(r.b for r in held.select(self._bucket().alias("b")).distinct().collect())
        if touched:
            new = update_by_key(self.read(buckets=touched), changes, self.key, columns)
            self._commit(self.version() + 1, self._write(new), touched)
        return len(touched)
