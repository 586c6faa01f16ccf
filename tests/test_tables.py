"""Stored tables: keyed updates, lookups by id, order statistics, file order, browser rounding."""

import os
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from carepath import schemas as S
from carepath.functions import scalar as X
from carepath.operators import serve as SV
from carepath.plans import serving_queries as Q
from carepath.session import shared_path
from carepath.sources import files, tables
from carepath.sources.keyed import KeyedTable, RepeatedKey
from conftest import SF_SMALL


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _files(table, version=None):
    return {f for b, folder in table.folders(version).items() for f in
            [os.path.join(d, x) for d, _, names in os.walk(f"{folder}/bucket={b}") for x in names if x.endswith(".parquet")]}


def test_update_rewrites_only_changed_buckets(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") * 2).alias("v"), F.lit(None).cast("string").alias("w"))
    table = KeyedTable.create(df, str(tmp_path / "t"), "id", buckets=16)
    before = _files(table)
    assert _rows(table.read()) == _rows(df) and table.version() == 1
    changes = spark.createDataFrame([(7, None, "a"), (8, 80, "b"), (5000, 1, "no such row")], "id long, v long, w string")
    assert table.update(changes, ["v", "w"]) in (1, 2)
    want = [(i, 80 if i == 8 else 2 * i, {7: "a", 8: "b"}.get(i)) for i in range(1000)]
    assert _rows(table.read()) == sorted(want, key=str)
    after = _files(table)
    assert len(before & after) >= 14 and all(os.path.exists(f) for f in before)      # untouched files keep their names
    assert _rows(table.read(version=1)) == _rows(df) and table.version() == 2
    assert table.update(changes.where("id = 5000"), ["v"]) == 0 and table.update(changes.limit(0), ["v"]) == 0
    assert table.version() == 2


def test_repeated_change_keys_are_refused(spark, tmp_path):
    df = spark.range(10).select("id", F.lit(0).alias("v"))
    table = KeyedTable.create(df, str(tmp_path / "t"), "id", buckets=4)
    for bad in ([(3, 1), (3, 2)], [(None, 1)], [(99, 1), (99, 1)]):
        with pytest.raises(RepeatedKey):
            table.update(spark.createDataFrame(bad, "id long, v int"), ["v"])
    assert table.version() == 1
    twice = spark.createDataFrame([(3, 1), (3, 2)], "id long, v int")
    with pytest.raises(Exception, match="repeats its key"):
        tables.update_by_key(df, twice, "id", ["v"]).collect()
    once = tables.update_by_key(df, twice.where("v = 2"), "id", ["v"])
    assert _rows(once) == [(i, 2 if i == 3 else 0) for i in range(10)]


def test_unfinished_update_is_not_seen(spark, tmp_path):
    table = KeyedTable.create(spark.range(50).select("id", F.lit(0).alias("v")), str(tmp_path / "t"), "id", buckets=4)
    table._write(spark.range(50).select("id", F.lit(9).alias("v")))       # written, never committed
    assert {r.v for r in table.read().collect()} == {0}


def test_lookup_reads_requested_ids_only(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_lookup(spark.range(0, 20_000, 2).select(F.col("id").alias("subject_id"), (F.col("id") / 7).alias("x")), path,
                        "subject_id", 20_000)
    table = spark.read.parquet(path)
    asked = spark.createDataFrame([(4,), (4,), (5,), (None,), (19_998,)], "subject_id long")
    got = SV.point_lookup(asked, table)
    want = [(4, True, 4 / 7), (5, False, None), (19_998, True, 19_998 / 7), (None, False, None)]
    assert _rows(got) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(subject_id, [19998,4,5])" in plan or "PushedFilters: [In(subject_id, [4,5,19998])" in plan
    assert _rows(SV.point_lookup(asked, table, max_ids=2)) == sorted(want, key=str)      # more ids than a list may have
    stored = E.queries()["point_lookup"](spark, SF_SMALL)
    assert "PushedFilters: [In(subject_id" in stored._jdf.queryExecution().executedPlan().toString()
    assert Q.serving_table(spark, SF_SMALL).inputFiles() == Q.serving_table(spark, SF_SMALL).inputFiles()


def test_order_statistics_of_continuous_and_odd_columns(spark):
    rnd = np.random.default_rng(4)
    n = 5000
    data = {"even": rnd.random(n), "wide": np.exp(rnd.normal(size=n) * 40) * rnd.choice([-1, 1], n),
            "ties": rnd.integers(0, 3, n).astype(float), "one": np.full(n, 2.5),
            "huge": rnd.choice([-1.7e308, 1.7e308, 0.0, 1.0], n)}
    rows = [[float(data[c][i]) for c in data] + [None if i % 3 else float(i), None] for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*data, "gaps", "nothing"]))
    got = {r.feature: r for r in SV.describe(df, df.columns).collect()}
    data["gaps"] = np.arange(0, n, 3).astype(float)
    for c, x in data.items():
        s = np.sort(x)
        for q, v in ((0.25, got[c].q25), (0.5, got[c].q50), (0.75, got[c].q75)):
            at = q * (len(s) - 1)
            lo, hi = s[int(np.floor(at))], s[int(np.ceil(at))]
            assert v == lo + (at - np.floor(at)) * (hi - lo), (c, q)
        assert got[c]["count"] == len(x) and got[c].min == s[0] and got[c].max == s[-1]
    assert got["nothing"]["count"] == 0 and got["nothing"].q50 is None
    assert SV.order_statistics(df, {"even": [0, 1, n - 1]}, buckets=2) == {
        ("even", r): np.sort(data["even"])[r] for r in (0, 1, n - 1)}


def test_places_over_several_files_are_those_of_a_sequential_read(spark):
    path = f"{shared_path(spark, 'ordered')}/NOTES.csv"
    df = spark.range(3000).select(F.col("id").alias("note_id"), F.repeat(F.lit("x"), 40).alias("text"))
    files.write_csv(df.repartitionByRange(5, F.desc("note_id")).sortWithinPartitions(F.desc("note_id")), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")       # files are split, and dealt in another order
    try:
        assert spark.read.csv(path).rdd.getNumPartitions() > 8
        got = files.scan_csv(spark, path, S.T.StructType([S.T.StructField("note_id", S.T.LongType())]), order="seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    names = sorted(os.path.join(d, x) for d, _, fs in os.walk(path.removeprefix("file:")) for x in fs if x.endswith(".csv"))
    assert len(names) > 1
    want = [int(line.split(",")[0]) for name in names for line in open(name).read().splitlines()[1:]]
    assert [r.note_id for r in sorted(got, key=lambda r: r.seq)] == want
    assert sorted(r.seq for r in got) == list(range(3000))


def test_browser_rounding(spark):
    values = [0.25, 0.35, 1.005, 2.5, 1.45, 8.345, -0.25, -0.04, 0.0, 1e10 + 0.25, 82.825, 1 / 3] + [i / 16 for i in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 3):
        got = [r[0] for r in df.select(X.fmt_browser("x", digits)).collect()]
        for v, text in zip(values, got, strict=True):
            exact = Decimal(abs(v)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP)
            assert text == ("-" if v < 0 else "") + str(exact), (v, digits)


def test_clear_tables_returns_the_reloaded_patients(spark, monkeypatch):
    from carepath.plans.context import Clinic
    got = E.queries()["clear_tables"](spark, SF_SMALL)
    assert got.columns == ["subject_id", "gender", "dob"]
    assert _rows(got) == _rows(Clinic(spark, SF_SMALL).patients.select("subject_id", "gender", "dob"))
    clear = tables.clear_tables
    monkeypatch.setattr(tables, "clear_tables", lambda spark, held: clear(spark, {k: v for k, v in held.items() if k != "notes"}))
    with pytest.raises(ValueError, match="notes"):
        E.queries()["clear_tables"](spark, SF_SMALL)
