"""Stored tables that are built once per state of their inputs.

A store is a shared folder with a manifest: one row for every finished build, (name,
fingerprint, folder, published). A build is written to a folder of its own and
becomes visible only by its manifest row, appended after all its tables are complete; a
build that dies halfway is never read. Builds are looked up by the fingerprint of their
inputs (file names, sizes and modification times, and any parameters), so changed inputs
lead to a new build and the old one stays for its readers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, fingerprint string, folder string, published timestamp"


def input_fingerprint(spark: SparkSession, paths: list[str], *params) -> str:
    """Digest of the state of the files under ``paths`` and of ``params``; no file is opened."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
             .select("path", "modificationTime", "length"))
    # sums do not depend on the order in which files are listed
    state = files.agg(F.count("*").alias("n"), *[
        F.sum(F.xxhash64("path", "modificationTime", "length", F.lit(seed)).cast("decimal(38,0)")).alias(f"s{seed}")
        for seed in (1, 2)]).first()
    return hashlib.sha256(repr((state.n, str(state.s1), str(state.s2), params)).encode()).hexdigest()


def manifest(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/manifest"
    spark.createDataFrame([], MANIFEST).write.mode("append").parquet(path)     # makes the folder on first use
    return spark.read.schema(MANIFEST).parquet(path)


def published(spark: SparkSession, root: str, name: str, fingerprint: str) -> str | None:
    """Folder of the latest finished build of ``name`` for this fingerprint."""
    found = (manifest(spark, root).where((F.col("name") == name) & (F.col("fingerprint") == fingerprint))
             .agg(F.max_by("folder", "published").alias("folder")).first())
    return found.folder


def publish(spark: SparkSession, root: str, name: str, fingerprint: str, folder: str) -> None:
    row = spark.createDataFrame([(name, fingerprint, folder)], "name string, fingerprint string, folder string")
    row.withColumn("published", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def get_or_build(spark: SparkSession, root: str, name: str, fingerprint: str, build: Callable[[str], None],
                 rebuild: bool = False) -> str:
    """Folder of the build for this fingerprint; ``build(folder)`` writes one if there is none (or ``rebuild``)."""
    folder = None if rebuild else published(spark, root, name, fingerprint)
    if folder is None:
        folder = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
        build(folder)
        publish(spark, root, name, fingerprint, folder)
    return folder
