"""Incremental load of export files with Structured Streaming.

The batch load appends cleaned rows in chunks. The streaming form of the
same work: new export files landing in a folder are picked up as
micro-batches (``maxFilesPerTrigger`` bounds a chunk), each micro-batch is
cleaned with the same functions as the batch path and appended to the
table with ``foreachBatch``. The checkpoint in the shared folder records
which files were committed, so a restarted query neither skips nor repeats
a file; the stream adds no operators of its own.

Dedup across micro-batches is not attempted here (first-row-wins needs the
whole history); run the batch ``dedup_first`` over the table to compact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from carepath.operators.clean import project_admissions, semi_valid_subjects


def admissions_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Admission exports (CSV, header, all text) as a stream."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in
                           ("seq", "hadm_id", "subject_id", "admittime", "dischtime", "admission_type")])
    return (spark.readStream.schema(schema).option("header", True)
            .option("maxFilesPerTrigger", files_per_batch).csv(folder))


def append_admissions(stream: DataFrame, patients_path: str, table_path: str,
                      checkpoint: str) -> StreamingQuery:
    """Clean each micro-batch against the stored patients table and append it."""
    def write(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        patients = spark.read.parquet(patients_path).select("subject_id")
        typed = batch.withColumn("seq", F.col("seq").cast("long")) \
                     .withColumn("hadm_id", F.col("hadm_id").cast("long")) \
                     .withColumn("subject_id", F.col("subject_id").cast("long"))
        known = semi_valid_subjects(typed, patients)
        project_admissions(known).write.mode("append").parquet(table_path)

    return (stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
