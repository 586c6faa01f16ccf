"""Property checks of scalar expressions against plain Python."""

import datetime as dt

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from carepath.functions import scalar as X

_STAMPS = st.datetimes(min_value=dt.datetime(1900, 1, 1), max_value=dt.datetime(2100, 12, 31))
# daylight-saving changes in the US zones used below
_DST = [dt.datetime(2001, 4, 1, 1, 30), dt.datetime(2001, 10, 28, 1, 30), dt.datetime(2021, 3, 14, 2, 30)]


@settings(max_examples=1, deadline=None)
@given(pairs=st.lists(st.tuples(_STAMPS, _STAMPS), min_size=200, max_size=200))
def test_micros_between_is_exact_in_any_session_zone(spark, pairs):
    pairs = pairs + [(d - dt.timedelta(hours=3), d + dt.timedelta(hours=5)) for d in _DST]
    df = spark.createDataFrame([(a.isoformat(sep=" "), b.isoformat(sep=" ")) for a, b in pairs], "a string, b string")
    df = df.select(X.safe_parse_ts("a").alias("a"), X.safe_parse_ts("b").alias("b"))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/Los_Angeles", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [r.us for r in df.select(X.micros_between("a", "b").alias("us")).collect()]
            want = [(b - a) // dt.timedelta(microseconds=1) for a, b in pairs]
            assert got == want, zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@settings(max_examples=1, deadline=None)
@given(xs=st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=300, max_size=300),
       dec=st.lists(st.integers(min_value=-10**7, max_value=10**7), min_size=300, max_size=300))
def test_fixed_formatting_matches_python_exactly(spark, xs, dec):
    # short decimals (x.xx5 and friends) are where shortest-repr rounding and Python disagree
    xs = xs + [k / 1000 for k in dec] + [2.675, 82.825, 1.005, 0.125, -0.125, 12.5, -2.675, -0.001, 0.0, 1234.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select(X.fmt_fixed("x", 2).alias("a"), X.fmt_fixed("x", 0).alias("b"),
                     X.fmt_fixed("x", 4, sign=True).alias("c"), X.fmt_percent("x").alias("d")).collect()
    for x, r in zip(xs, rows):
        assert (r.a, r.b, r.c, r.d) == (f"{x:.2f}", f"{x:.0f}", f"{x:+.4f}", f"{x:.1%}"), x
