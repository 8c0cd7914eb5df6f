"""Explicit schemas and fixed constants.

Every reader in the package takes one of these schemas; nothing is
inferred (CSV inference would turn keys and ZIP codes into integers).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must stay equal to the reference's for equal results.
#   rollup zoom level -> grid cell size in degrees: 10 -> 0.0200, 12 -> 0.0100, 14 -> 0.0045
#   live grid cell size: 0.0045 degrees (about 500 m), whatever the zoom
#   time rollup bucket types: hour, day, week (weeks start on Monday)
#   points page: default limit 500, max limit 5000; timeseries: default 90, max 500
#   scheduled sync: gate every 5 days, look back 7 days
#   map viewport: points limit 250, grid min_count 2, points from zoom 15, grid hidden from zoom 17
#   density classes: high if count > 2.5 x mean, medium if count > mean, else low
#   default viewport: lat 40.4774 .. 40.9176, lon -74.2591 .. -73.7002
#   boroughs: BRONX, BROOKLYN, MANHATTAN, QUEENS, STATEN ISLAND
#   stream consumer name / topic: noise-complaints-postgres / noise-complaints
#   error text kept in ledgers: 1000 characters
#   source tags: scheduled sync "socrata", producer "csv", consumer default "kafka", table default "unknown"
# ---------------------------------------------------------------------------
ZOOM_GRID_SIZES: dict[int, float] = {10: 0.0200, 12: 0.0100, 14: 0.0045}
LIVE_GRID_SIZE = 0.0045
TIME_BUCKETS = ("hour", "day", "week")
DEFAULT_LIMIT = 500
MAX_LIMIT = 5000
TIMESERIES_DEFAULT_LIMIT = 90
TIMESERIES_MAX_LIMIT = 500
SYNC_INTERVAL_DAYS = 5
LOOKBACK_DAYS = 7
UI_POINTS_LIMIT = 250
UI_MIN_COUNT = 2
MIXED_MODE_MIN_ZOOM = 15
POINTS_ONLY_MIN_ZOOM = 17
DENSITY_HIGH_FACTOR = 2.5
DEFAULT_VIEWPORT = (40.4774, 40.9176, -74.2591, -73.7002)
BOROUGHS = ("BRONX", "BROOKLYN", "MANHATTAN", "QUEENS", "STATEN ISLAND")
CONSUMER_NAME = "noise-complaints-postgres"
TOPIC = "noise-complaints"
ERROR_TEXT_MAX = 1000
SYNC_SOURCE = "socrata"
PRODUCER_SOURCE = "csv"
STREAM_DEFAULT_SOURCE = "kafka"
TABLE_DEFAULT_SOURCE = "unknown"

# Fixed "now" of the fixtures: the events cover 2024-01-01 .. 2024-01-30.
FIXTURE_AS_OF = _dt.datetime(2024, 1, 31, 0, 0, 0)

STR = T.StringType()
NTZ = T.TimestampNTZType()
DBL = T.DoubleType()

# The 18 business columns carried by every complaint record, in table order.
BUSINESS_COLUMNS = (
    "unique_key",
    "created_date",
    "closed_date",
    "agency",
    "agency_name",
    "complaint_type",
    "descriptor",
    "status",
    "borough",
    "city",
    "incident_zip",
    "incident_address",
    "street_name",
    "cross_street_1",
    "cross_street_2",
    "location_type",
    "latitude",
    "longitude",
)
DATE_COLUMNS = ("created_date", "closed_date")
COORD_COLUMNS = ("latitude", "longitude")
# Business columns plus the source tag: what an upsert writes.
RECORD_COLUMNS = BUSINESS_COLUMNS + ("source",)


def _business_field(name: str, *, text: bool) -> T.StructField:
    if text:
        return T.StructField(name, STR, True)
    if name in DATE_COLUMNS:
        return T.StructField(name, NTZ, True)
    if name in COORD_COLUMNS:
        return T.StructField(name, DBL, True)
    return T.StructField(name, STR, name != "unique_key")


# Typed raw complaint table (the current view).
COMPLAINT_SCHEMA = T.StructType(
    [_business_field(c, text=False) for c in BUSINESS_COLUMNS]
    + [T.StructField("source", STR, False), T.StructField("ingested_at", NTZ, False)]
)

# A message, CSV row or extracted row: all business columns are text.
MESSAGE_SCHEMA = T.StructType(
    [_business_field(c, text=True) for c in BUSINESS_COLUMNS] + [T.StructField("source", STR, True)]
)

GRID_ROLLUP_SCHEMA = T.StructType(
    [
        T.StructField("zoom_level", T.IntegerType(), False),
        T.StructField("grid_size_degrees", DBL, False),
        T.StructField("borough", STR, True),
        T.StructField("complaint_type", STR, True),
        T.StructField("lat_bucket", DBL, True),
        T.StructField("lon_bucket", DBL, True),
        T.StructField("center_lat", DBL, True),
        T.StructField("center_lon", DBL, True),
        T.StructField("complaint_count", T.LongType(), False),
        T.StructField("earliest_created_date", NTZ, True),
        T.StructField("latest_created_date", NTZ, True),
        T.StructField("refreshed_at", NTZ, True),
    ]
)

# The mergeable form of both rollups: group keys, count, exact sums of the coordinates, date range.
ROLLUP_STATE_SCHEMA = T.StructType(
    [
        T.StructField("kind", STR, False),
        *[T.StructField(f.name, f.dataType, True) for f in GRID_ROLLUP_SCHEMA.fields[:6]],
        T.StructField("bucket_type", STR, True),
        T.StructField("bucket_start", NTZ, True),
        T.StructField("complaint_count", T.LongType(), False),
        *[
            T.StructField(f"{c}_{part}", DBL if part == "odd" else T.LongType(), True)
            for c in ("lat", "lon")
            for part in ("hi", "mid", "lo", "odd")
        ],
        T.StructField("earliest_created_date", NTZ, True),
        T.StructField("latest_created_date", NTZ, True),
    ]
)

TIME_ROLLUP_SCHEMA = T.StructType(
    [
        T.StructField("bucket_type", STR, False),
        T.StructField("bucket_start", NTZ, True),
        T.StructField("borough", STR, True),
        T.StructField("complaint_type", STR, True),
        T.StructField("complaint_count", T.LongType(), False),
        T.StructField("refreshed_at", NTZ, True),
    ]
)

# Append-only run events; the ledgers are folds over them.
RUN_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("job_name", STR, False),
        T.StructField("run_seq", T.LongType(), False),
        T.StructField("event_at", NTZ, False),
        T.StructField("status", STR, False),
        T.StructField("error", STR, True),
        T.StructField("rows_processed", T.IntegerType(), True),
    ]
)
