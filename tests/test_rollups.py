import datetime as dt

from pyspark.sql import functions as F

from gridpulse import schema as S
from gridpulse.operators import rollups as R
from gridpulse.sources import fixtures as X
from helpers import BASE_TS, complaint, complaints_df

SF = "/root/testdata/sf0.001"


def test_null_borough_forms_one_group(spark):
    df = complaints_df(spark, [complaint(1, borough=None), complaint(2, borough=None)])
    out = R.grid_rollups(df).where("zoom_level = 14").collect()
    assert len(out) == 1 and out[0].borough is None and out[0].complaint_count == 2


def test_grid_invariants_on_fixture(spark):
    c = X.complaints_from_events(X.read_events(spark, SF))
    roll = R.grid_rollups(c, refreshed_at=S.FIXTURE_AS_OF)
    sums = {r.zoom_level: r.n for r in roll.groupBy("zoom_level").agg(F.sum("complaint_count").alias("n")).collect()}
    expected = c.where("latitude IS NOT NULL AND longitude IS NOT NULL AND complaint_type ILIKE 'Noise%'").count()
    assert set(sums) == {10, 12, 14}
    assert all(v == expected for v in sums.values())
    # the centroid lies inside its cell (up to float tolerance)
    bad = roll.where(
        (F.col("center_lat") < F.col("lat_bucket") - 1e-9)
        | (F.col("center_lat") > F.col("lat_bucket") + F.col("grid_size_degrees") + 1e-9)
        | (F.col("center_lon") < F.col("lon_bucket") - 1e-9)
        | (F.col("center_lon") > F.col("lon_bucket") + F.col("grid_size_degrees") + 1e-9)
    ).count()
    assert bad == 0


def test_explode_equals_union_of_levels(spark):
    c = X.complaints_from_events(X.read_events(spark, SF))
    one_scan = R.grid_rollups(c)
    per_level = None
    for z, g in S.ZOOM_GRID_SIZES.items():
        part = R.grid_rollups(c, zooms={z: g})
        per_level = part if per_level is None else per_level.unionByName(part)
    assert one_scan.exceptAll(per_level).count() == 0 and per_level.exceptAll(one_scan).count() == 0


def test_time_rollup_sums_equal_across_bucket_types(spark):
    c = X.complaints_from_events(X.read_events(spark, SF))
    t = R.time_rollups(c)
    sums = {r.bucket_type: r.n for r in t.groupBy("bucket_type").agg(F.sum("complaint_count").alias("n")).collect()}
    assert sums["hour"] == sums["day"] == sums["week"] > 0


def test_time_rollup_null_rules(spark):
    rows = [complaint(1, lat=None, lon=None), complaint(2, created=None)]
    df = complaints_df(spark, rows)
    canon = R.time_rollups(df).where("bucket_type = 'day'").collect()
    assert [(r.bucket_start, r.complaint_count) for r in canon] == [(dt.datetime(2024, 6, 9), 1)]
    off = R.time_rollups(df, noise="contains_ci", require_created=False, require_coords=True)
    off = off.where("bucket_type = 'day'").collect()
    assert [(r.bucket_start, r.complaint_count) for r in off] == [(None, 1)]


def test_grid_500m_keeps_null_cells(spark):
    df = complaints_df(spark, [complaint(1, lat=None, lon=None), complaint(2, lat=None, lon=None), complaint(3)])
    out = {(r.lat_bucket, r.lon_bucket): r.complaint_count for r in R.grid_500m(df).collect()}
    assert out[(None, None)] == 2


def test_type_counts_order(spark):
    df = complaints_df(spark, [complaint(1, ctype="A"), complaint(2, ctype="B"), complaint(3, ctype="B")])
    assert [(r.complaint_type, r["count"]) for r in R.type_counts(df).collect()] == [("B", 2), ("A", 1)]
