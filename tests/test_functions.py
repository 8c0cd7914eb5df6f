import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridpulse.functions import grid_bucket, iso_timestamp, noise_rule, parse_iso_param, py_strip, text_to_double, time_bucket


def test_noise_rules_edge_table(spark):
    values = ["Noise - X", " Noise - X", "noise - x", "Loud Noise", "Parking", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, complaint_type string")
    rules = ["ilike_prefix", "contains_ci", "contains_cs", "like_prefix"]
    rows = df.select("i", *[noise_rule(r).alias(r) for r in rules]).orderBy("i").collect()
    got = {r: [row[r] for row in rows] for r in rules}
    assert got["ilike_prefix"] == [True, False, True, False, False, None]
    assert got["contains_ci"] == [True, True, True, True, False, None]
    assert got["contains_cs"] == [True, True, False, True, False, False]
    assert got["like_prefix"] == [True, False, False, False, False, None]


def test_contains_cs_strips_tabs_and_newlines(spark):
    df = spark.createDataFrame([("\tNoise\n",), ("xNoise",)], "complaint_type string")
    assert [r[0] for r in df.select(noise_rule("contains_cs")).collect()] == [True, True]


def test_unknown_rule():
    with pytest.raises(ValueError):
        noise_rule("nope")


def test_negative_floor_and_cell_edge(spark):
    df = spark.createDataFrame([(-74.0001, 40.48)], "lon double, lat double")
    row = df.select(
        F.floor(F.col("lon") / 0.01).alias("lon_idx"),
        F.floor(F.col("lat") / 0.01).alias("lat_idx"),
        grid_bucket("lon", 0.01).alias("lon_b"),
    ).first()
    assert row.lon_idx == -7401
    assert row.lat_idx == 4047  # 40.48 / 0.01 is 4047.9999..., IEEE division, no rounding
    assert row.lon_b == -7401 * 0.01


def test_week_starts_monday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 6, 9, 10, 30, 15),)], "ts timestamp_ntz")
    row = df.select(*[time_bucket(b, "ts").alias(b) for b in ("hour", "day", "week")]).first()
    assert row.hour == dt.datetime(2024, 6, 9, 10, 0)
    assert row.day == dt.datetime(2024, 6, 9)
    assert row.week == dt.datetime(2024, 6, 3)


def test_time_bucket_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30),)], "ts timestamp_ntz")
        assert df.select(time_bucket("hour", "ts")).first()[0] == dt.datetime(2024, 3, 10, 2, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_iso_timestamp_zones(spark):
    values = [
        "2024-06-09T10:00:00Z",
        "2024-06-09T10:00:00+05:00",
        "2024-06-09T10:00:00-0230",
        "2024-06-09T10:00:00.000",
        "2024-06-09",
        "",
        "not-a-date",
        None,
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(iso_timestamp(F.col("s"))).collect()]
    assert got == [
        dt.datetime(2024, 6, 9, 10, 0),
        dt.datetime(2024, 6, 9, 5, 0),
        dt.datetime(2024, 6, 9, 12, 30),
        dt.datetime(2024, 6, 9, 10, 0),
        dt.datetime(2024, 6, 9, 0, 0),
        None,
        None,
        None,
    ]


def test_text_to_double(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([" 1.5 ", "", "abc", "40.4774", None])], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(text_to_double(F.col("s"))).collect()]
    assert got == [1.5, None, None, 40.4774, None]


def test_iso_timestamp_is_strict(spark):
    bad = [
        "2024", "2024-01", "2024-1-5", "+2024-01-05", " 2024-01-05", "2024-01-05 ", "2024-01-05T10:00:00 UTC",
        "2024-01-05 10:00:00 America/New_York", "2024-01-05T10:00:00z", "2024-13-01", "2024-02-30", "2024-01-05T25:00:00",
        "2024-01-05T10:00:00+25:00", "2024-01-05T", "2024-01-05T1:00", "2024-W01-1",
    ]
    good = {
        "20240105": dt.datetime(2024, 1, 5), "2024-01-05T10": dt.datetime(2024, 1, 5, 10), "2024-01-05T10:30": dt.datetime(2024, 1, 5, 10, 30),
        "20240105T103001Z": dt.datetime(2024, 1, 5, 10, 30, 1), "2024-01-05T10:00:00.5+01": dt.datetime(2024, 1, 5, 9, 0, 0, 500000),
        "2024-01-05 10:00:00,123456789": dt.datetime(2024, 1, 5, 10, 0, 0, 123456), "2024-01-05T10:00:00.000001": dt.datetime(2024, 1, 5, 10, 0, 0, 1),
        "2024-01-01T00:30:00+0100": dt.datetime(2023, 12, 31, 23, 30),
    }
    df = spark.createDataFrame([(x,) for x in [*bad, *good]], "s string")
    got = {r.s: r.t for r in df.select("s", iso_timestamp(F.col("s")).alias("t")).collect()}
    assert {x: got[x] for x in bad} == dict.fromkeys(bad) and {x: got[x] for x in good} == good


def test_text_to_double_is_strict(spark):
    bad = ["40.5d", "40.5f", "0x1p3", "1__0", "_1", "1_", "1 0", "--1", "e5", "."]
    good = {"1_0.5": 10.5, "\u00a040.5\u2003": 40.5, "\t-7.\n": -7.0, ".5": 0.5, "1e3": 1000.0, "+inf": float("inf"), "Infinity": float("inf")}
    df = spark.createDataFrame([(x,) for x in [*bad, *good, "NaN"]], "s string")
    got = {r.s: r.x for r in df.select("s", text_to_double(F.col("s")).alias("x")).collect()}
    assert {x: got[x] for x in bad} == dict.fromkeys(bad) and {x: got[x] for x in good} == good and got["NaN"] != got["NaN"]


def test_strip_takes_every_blank(spark):
    df = spark.createDataFrame([("\u00a0\u2003 Noise \u3000\x1c\x85",)], "s string")
    assert df.select(py_strip(F.col("s"))).first()[0] == "Noise"


def test_parse_iso_param():
    assert parse_iso_param("") is None
    assert parse_iso_param(None) is None
    assert parse_iso_param("2024-06-09T10:00:00Z") == dt.datetime(2024, 6, 9, 10, 0)
    assert parse_iso_param("2024-06-09T10:00:00+05:00") == dt.datetime(2024, 6, 9, 5, 0)
    with pytest.raises(ValueError):
        parse_iso_param("yesterday")


def test_ntz_literals_ignore_session_zone(spark):
    from gridpulse.functions import ntz_lit

    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        got = spark.range(1).select(ntz_lit(dt.datetime(2024, 1, 31, 0, 0, 0)).alias("t")).first().t
        assert got == dt.datetime(2024, 1, 31, 0, 0, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_grid_bucket_non_finite_like_sql(spark):
    import duckdb, math

    vals = [float("nan"), float("inf"), float("-inf"), None, -74.0001]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(grid_bucket("x", 0.01)).collect()]
    want = [duckdb.sql(f"SELECT FLOOR(CAST('{v}' AS DOUBLE) / CAST('0.01' AS DOUBLE)) * CAST('0.01' AS DOUBLE)").fetchall()[0][0]
            if v is not None else None for v in vals]
    assert math.isnan(got[0]) and math.isnan(want[0])
    assert got[1:] == want[1:]
