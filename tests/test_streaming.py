"""Streaming load appends exactly the cleaned rows of every export file, once."""

from pyspark.sql import functions as F

from carepath.operators.clean import project_admissions, semi_valid_subjects
from carepath.plans.context import Clinic
from carepath.session import shared_path
from carepath.sources import files
from carepath.streaming.ingest import admissions_stream, append_admissions
from conftest import SF_SMALL


def test_stream_appends_each_file_once(spark):
    c = Clinic(spark, SF_SMALL)
    root = shared_path(spark, "stream")
    pats = f"{root}/patients"
    c.patients.write.parquet(pats)
    raw = c.admissions_raw
    # three export drops, by order key range
    for i, (lo, hi) in enumerate([(0, 2000), (2000, 4000), (4000, 10**9)]):
        part = raw.filter((F.col("hadm_id") >= lo) & (F.col("hadm_id") < hi)).coalesce(1)
        files.write_csv(part, f"{root}/drop{i}")
    import glob
    import shutil
    import os
    inbox = f"{root}/inbox"
    os.makedirs(inbox)
    for i in range(3):
        for f in glob.glob(f"{root}/drop{i}/*.csv"):
            shutil.copy(f, f"{inbox}/drop{i}.csv")
    q = append_admissions(admissions_stream(spark, inbox), pats, f"{root}/admissions", f"{root}/ckpt")
    q.awaitTermination()
    q2 = append_admissions(admissions_stream(spark, inbox), pats, f"{root}/admissions", f"{root}/ckpt")
    q2.awaitTermination()          # restart: nothing new, nothing repeated
    got = spark.read.parquet(f"{root}/admissions")
    want = project_admissions(semi_valid_subjects(raw, c.patients))
    cols = ["seq", "hadm_id", "subject_id", "admittime", "dischtime", "admission_type"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
