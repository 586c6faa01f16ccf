"""Spark session and shared-folder helpers.

Everything in the library takes a ``SparkSession`` argument; this module only
builds one for tests, benches and the command line, and resolves the shared
folder used to cut lineage and hold written tables.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings of the sessions built here, for local runs and tests; a cluster
# deployment brings its own session.
_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "carepath") -> SparkSession:
    """Session for local runs and tests (``local[N]``); clusters bring their own."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    builder = builder.config("spark.driver.memory", "16g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating one only when unset and the master is local.

    On a cluster ``spark.checkpoint.dir`` names a shared file system folder
    (HDFS/S3/ABFS) that survives executor loss; it is read, never replaced.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if conf_dir:
        if not current:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="carepath-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def shared_path(spark: SparkSession, name: str, unique: bool = True) -> str:
    """A fresh folder under the shared checkpoint root for a written table."""
    root = ensure_checkpoint_dir(spark)
    # setCheckpointDir appends a uuid sub-folder; keep tables beside it
    leaf = f"{name}-{uuid.uuid4().hex[:12]}" if unique else name
    return f"{root.rstrip('/')}/tables/{leaf}"
