import datetime as dt

import pytest

from gridpulse.operators import filters as FL
from gridpulse.operators.filters import ComplaintFilter, complaint_filter
from gridpulse.plans.serving import choose_rollup_zoom
from helpers import BASE_TS, complaint, complaints_df


def _keys(df):
    return sorted(r.unique_key for r in df.collect())


def test_inclusive_date_range(spark):
    start, end = BASE_TS, BASE_TS + dt.timedelta(days=1)
    rows = [complaint(1, created=start), complaint(2, created=end), complaint(3, created=end + dt.timedelta(seconds=1)),
            complaint(4, created=None)]
    df = complaints_df(spark, rows)
    got = df.where(complaint_filter(ComplaintFilter(start_date=start, end_date=end)))
    assert _keys(got) == ["1", "2"]
    # no bound: the NULL date stays
    assert _keys(df.where(complaint_filter(ComplaintFilter()))) == ["1", "2", "3", "4"]


def test_borough_parameter_upper_cased_data_not(spark):
    df = complaints_df(spark, [complaint(1, borough="QUEENS"), complaint(2, borough="Queens")])
    assert _keys(df.where(complaint_filter(ComplaintFilter(borough="queens")))) == ["1"]


def test_empty_string_not_applied_zero_applied(spark):
    df = complaints_df(spark, [complaint(1, lat=-1.0), complaint(2, lat=1.0)])
    assert _keys(df.where(complaint_filter(ComplaintFilter(borough="")))) == ["1", "2"]
    assert _keys(df.where(complaint_filter(ComplaintFilter(min_lat=0)))) == ["2"]


def test_coordinates_required(spark):
    df = complaints_df(spark, [complaint(1, lat=None), complaint(2, lon=None), complaint(3)])
    assert _keys(df.where(complaint_filter(ComplaintFilter()))) == ["3"]


@pytest.mark.parametrize("zoom,expected", [(None, 14), (1, 10), (10, 10), (11, 12), (12, 12), (13, 14), (22, 14)])
def test_zoom_choice(zoom, expected):
    assert choose_rollup_zoom(zoom) == expected


def test_argument_checks():
    with pytest.raises(ValueError):
        FL.check_limit(0)
    assert FL.check_limit(1) == 1
    assert FL.check_limit(5000) == 5000
    with pytest.raises(ValueError):
        FL.check_limit(5001)
    assert FL.check_limit(4000, max_limit=1000) == 1000
    assert FL.check_limit(None) == 500
    with pytest.raises(ValueError):
        FL.check_offset(-1)
    with pytest.raises(ValueError):
        FL.check_min_count(0)
    with pytest.raises(ValueError):
        FL.check_zoom(23)
    with pytest.raises(ValueError):
        FL.check_bucket_type("month")
    assert FL.check_timeseries_limit(None) == 90
    with pytest.raises(ValueError):
        FL.check_timeseries_limit(501)
    with pytest.raises(ValueError):
        ComplaintFilter(start_date="garbage").dates()
