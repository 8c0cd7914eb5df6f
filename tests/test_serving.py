import datetime as dt

import pytest

from gridpulse.operators import rollups as R
from gridpulse.operators.filters import ComplaintFilter
from gridpulse.plans import serving as V
from gridpulse.sources.store import VersionedStore
from gridpulse import schema as S
from helpers import BASE_TS, complaint, complaints_df


def _one_cell_two_types(spark):
    return complaints_df(
        spark,
        [complaint(1, lat=40.70001, lon=-73.90001, ctype="Noise - Residential"),
         complaint(2, lat=40.70002, lon=-73.90002, ctype="Noise - Commercial")],
    )


def test_rollup_plan_vs_live_plan(spark):
    df = _one_cell_two_types(spark)
    q = V.GridQuery(min_count=2)
    assert V.grid_from_rollups(R.grid_rollups(df), q).count() == 0
    live = V.grid_live(df, q).collect()
    assert len(live) == 1 and live[0]["count"] == 2 and live[0].zoom_level is None


def test_routing_date_bound_goes_live(spark, scratch):
    df = _one_cell_two_types(spark)
    roll = R.grid_rollups(df)
    q = V.GridQuery(flt=ComplaintFilter(start_date=BASE_TS - dt.timedelta(days=1)), min_count=2)
    assert V.grid_summary(roll, df, q).count() == 1  # live plan answered
    q2 = V.GridQuery(min_count=2)
    assert V.grid_summary(roll, df, q2).count() == 0  # rollup plan answered


def test_routing_missing_version_goes_live(spark, scratch):
    df = _one_cell_two_types(spark)
    store = VersionedStore(spark, scratch("empty-store"), S.GRID_ROLLUP_SCHEMA)
    out = V.grid_summary(store.resolver(), df, V.GridQuery(min_count=2)).collect()
    assert len(out) == 1 and out[0]["count"] == 2


def test_density_classes(spark):
    cells = spark.createDataFrame([(1,), (1,), (1,), (9,)], "count long")
    got = sorted((r["count"], r.density_class) for r in V.density_classes(cells).collect())
    assert got == [(1, "low"), (1, "low"), (1, "low"), (9, "high")]
    empty = spark.createDataFrame([], "count long")
    assert V.density_classes(empty).count() == 0


def test_finite_points(spark):
    pts = spark.createDataFrame([(1.0, 2.0), (float("nan"), 2.0), (float("inf"), 1.0), (1.0, None)], "lat double, lon double")
    assert V.finite_points(pts).count() == 1


def test_points_page_order_and_offset(spark):
    rows = [complaint(i, created=BASE_TS + dt.timedelta(hours=i)) for i in range(5)] + [complaint(9, created=None)]
    df = complaints_df(spark, rows)
    first = [r.unique_key for r in V.points_page(df, limit=3).collect()]
    assert first == ["9", "4", "3"]  # NULL dates first when descending
    assert [r.unique_key for r in V.points_page(df, limit=3, offset=3).collect()] == ["2", "1", "0"]
    with pytest.raises(ValueError):
        V.points_page(df, limit=0)


def test_timeseries_limit_counts_rows(spark):
    rows = [complaint(i, borough=b, created=BASE_TS) for i, b in enumerate(["QUEENS", "BRONX", "BROOKLYN"])]
    t = R.time_rollups(complaints_df(spark, rows))
    out = V.timeseries(t, "day", limit=2).collect()
    assert len(out) == 2 and all(r.bucket_start == dt.datetime(2024, 6, 9) for r in out)
    with pytest.raises(ValueError):
        V.timeseries(t, "month")


def test_overview_bundle(spark):
    rows = [complaint(1, borough=None), complaint(2, borough="QUEENS"), complaint(3, lat=None)]
    ov = V.overview(complaints_df(spark, rows))
    o = ov.overview.first()
    assert (o.total_complaints, o.complaint_types, o.boroughs) == (2, 1, 1)
    assert sorted((r.borough or "", r["count"]) for r in ov.counts_by_borough.collect()) == [("", 1), ("QUEENS", 1)]


def test_viewport_points_from_zoom_15(spark):
    df = _one_cell_two_types(spark)
    roll = R.grid_rollups(df)
    assert V.viewport(roll, df, zoom_level=14).points is None
    vp = V.viewport(roll, df, zoom_level=17)
    assert vp.points is not None and not vp.show_grid
    row = V.viewport_counts(vp).first()
    assert (row.visible_points, row.visible_cells) == (2, 0)


@pytest.mark.parametrize("limit,offset", [(1, 0), (3, 0), (2, 3), (5, 1), (10, 0)])
def test_pruned_page_equals_full_sort(spark, limit, offset):
    rows = [complaint(i, created=BASE_TS + dt.timedelta(days=i % 4, hours=i)) for i in range(12)]
    rows += [complaint(100 + i, created=None) for i in range(2)]
    df = complaints_df(spark, rows)
    pruned = [r.unique_key for r in V.points_page(df, limit=limit, offset=offset).collect()]
    full = [r.unique_key for r in V.points_page(df, limit=limit, offset=offset, prune=False).collect()]
    assert pruned == full


def test_pruned_page_reads_only_newest(spark):
    from gridpulse.sources import fixtures as X

    c = X.complaints_table(spark, "/root/testdata/sf0.01")
    import contextlib, io

    # ~99 rows have no date and sort first: a 50-row page needs only them ...
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        V.points_page(c, limit=50).explain(mode="formatted")
    assert "IsNull(created_date)" in buf.getvalue() and "GreaterThanOrEqual(created_date" not in buf.getvalue()
    # ... a 500-row page also needs the newest dated rows, down to a cutoff day
    page = V.points_page(c, limit=500)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        page.explain(mode="formatted")
    assert "GreaterThanOrEqual(created_date" in buf.getvalue()


@pytest.mark.parametrize("limit,offset", [(5, 0), (7, 20), (50, 10)])
def test_page_on_a_hot_day_equals_the_full_sort(spark, limit, offset):
    rows = [complaint(i, created=BASE_TS - dt.timedelta(days=i % 3 and i)) for i in range(60)] + [complaint(900, created=None)]
    df = complaints_df(spark, rows)
    pruned = [r.unique_key for r in V.points_page(df, limit=limit, offset=offset).collect()]
    assert pruned == [r.unique_key for r in V.points_page(df, limit=limit, offset=offset, prune=False).collect()]


def test_cutoff_collects_no_more_days_than_rows_needed(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    df = complaints_df(spark, [complaint(i, created=BASE_TS - dt.timedelta(days=i)) for i in range(80)])
    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(collect(self)) or seen[-1])
    cutoff = V.newest_cutoff(df, 3)
    assert [len(x) for x in seen] == [3] and df.where(cutoff).count() == 3
    assert V.newest_cutoff(df, 1000) is None


def test_stored_version_without_counts_goes_live(spark, scratch):
    from gridpulse import schema as S
    from gridpulse.sources.store import VersionedStore

    df = _one_cell_two_types(spark)
    store = VersionedStore(spark, scratch("broken"), S.GRID_ROLLUP_SCHEMA)
    store.publish(spark.createDataFrame([(14, "QUEENS")], "zoom_level int, borough string"))
    out = V.grid_summary(store.resolver(), df, V.GridQuery(min_count=2)).collect()
    assert len(out) == 1 and out[0]["count"] == 2


def test_routing_broken_rollup_goes_live(spark):
    df = _one_cell_two_types(spark)
    broken = spark.createDataFrame([(1,)], "unrelated int")  # a stored version without rollup columns
    out = V.grid_summary(broken, df, V.GridQuery(min_count=2)).collect()
    assert len(out) == 1 and out[0]["count"] == 2


def test_overview_cube_equals_direct_aggregates(spark):
    from pyspark.sql import functions as F
    from gridpulse.sources import fixtures as X

    c = X.complaints_table(spark, "/root/testdata/sf0.001")
    flt = ComplaintFilter(start_date="2024-01-03")
    ov = V.overview(c, flt)
    base = c.where(V.overview_filter(flt))
    direct = base.agg(F.count(F.lit(1)), F.count_distinct("complaint_type"), F.count_distinct("borough"),
                      F.min("created_date"), F.max("created_date")).first()
    assert tuple(ov.overview.first()) == tuple(direct)
    assert sorted(map(tuple, ov.counts_by_borough.collect()), key=str) == sorted(
        map(tuple, base.groupBy("borough").count().collect()), key=str)
    empty = V.overview(c, ComplaintFilter(start_date="2030-01-01")).overview.first()
    assert (empty.total_complaints, empty.complaint_types, empty.earliest_created_date) == (0, 0, None)
