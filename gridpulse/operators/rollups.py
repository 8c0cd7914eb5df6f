"""Grid and time rollups.

The reference re-scans the raw table once per zoom level / bucket type and
unions the results. Here every rollup is ONE scan: each row is exploded into
one copy per level inside the scan stage, then a single hash aggregate
(partial on the map side, final after one shuffle on the group key) builds
all levels at once. Every measure is algebraic (count, exact sums for the
centre, min, max), so a hot cell holding a third of all rows still ships at most
one partial row per map task, and no centre depends on the order of the rows.

``rollup_state`` builds the grid and the time rollup together: one scan and one
shuffle for both, in a form that further rows can be added to or taken from.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse import schema as S
from gridpulse.functions import grid_bucket, mean_of, noise_rule, ntz_lit, split, sum_parts, time_bucket
from gridpulse.functions.exact import PARTS
from gridpulse.operators.filters import all_of, coords_present


def _ts(value: _dt.datetime) -> Column:
    return ntz_lit(value)


def _zoom_levels(zooms: dict[int, float]) -> Column:
    return F.explode(
        F.array(
            *[
                F.struct(F.lit(int(z)).alias("zoom_level"), F.lit(float(g)).alias("grid_size_degrees"))
                for z, g in zooms.items()
            ]
        )
    ).alias("level")


_PART_COLUMNS = [f"{c}_{p}" for c in ("lat", "lon") for p in PARTS]
_GRID_KEYS = ("zoom_level", "grid_size_degrees", "borough", "complaint_type", "lat_bucket", "lon_bucket")


def _coordinates() -> list[Column]:
    """The parts of both coordinates, for sums without rounding."""
    return [*split(F.col("latitude"), "lat"), *split(F.col("longitude"), "lon")]


def _centres(count: str) -> list[Column]:
    return [mean_of("lat", F.col(count)).alias("center_lat"), mean_of("lon", F.col(count)).alias("center_lon")]


def mean_cells(points: DataFrame, size: float) -> DataFrame:
    """(lat_bucket, lon_bucket, complaint_count, center_lat, center_lon) of points(latitude, longitude)."""
    cells = points.select(
        grid_bucket("latitude", size).alias("lat_bucket"), grid_bucket("longitude", size).alias("lon_bucket"), *_coordinates()
    )
    # a null coordinate makes a null bucket, so the points of a cell have both their values or none
    cells = cells.groupBy("lat_bucket", "lon_bucket").agg(F.count(F.lit(1)).alias("complaint_count"), *sum_parts("lat"), *sum_parts("lon"))
    return cells.select("lat_bucket", "lon_bucket", "complaint_count", *_centres("complaint_count"))


def grid_rollups(
    complaints: DataFrame,
    *,
    zooms: dict[int, float] | None = None,
    noise: str | None = "ilike_prefix",
    refreshed_at: _dt.datetime | None = None,
) -> DataFrame:
    """Multi-zoom grid rollup: one row per (zoom, borough, type, cell).

    ``noise="ilike_prefix"`` + ``refreshed_at`` is the canonical rebuild;
    ``noise="contains_ci"`` without ``refreshed_at`` is the offline job.
    Centre = mean of the points (centroid), not the middle of the cell.
    A NULL borough or type forms its own group.
    """
    zooms = zooms or S.ZOOM_GRID_SIZES
    preds = [coords_present()]
    if noise:
        preds.append(noise_rule(noise))
    levels = (
        complaints.where(all_of(preds))
        .select("borough", "complaint_type", "created_date", "latitude", "longitude", *_coordinates(), _zoom_levels(zooms))
        .select(
            F.col("level.zoom_level").alias("zoom_level"),
            F.col("level.grid_size_degrees").alias("grid_size_degrees"),
            "borough",
            "complaint_type",
            grid_bucket("latitude", F.col("level.grid_size_degrees")).alias("lat_bucket"),
            grid_bucket("longitude", F.col("level.grid_size_degrees")).alias("lon_bucket"),
            *_PART_COLUMNS,
            "created_date",
        )
    )
    out = levels.groupBy("zoom_level", "grid_size_degrees", "borough", "complaint_type", "lat_bucket", "lon_bucket").agg(
        *sum_parts("lat"),
        *sum_parts("lon"),
        F.count(F.lit(1)).alias("complaint_count"),
        F.min("created_date").alias("earliest_created_date"),
        F.max("created_date").alias("latest_created_date"),
    )
    out = out.select(*_GRID_KEYS, *_centres("complaint_count"), "complaint_count", "earliest_created_date", "latest_created_date")
    if refreshed_at is not None:
        out = out.withColumn("refreshed_at", _ts(refreshed_at))
    return out


def grid_500m(complaints: DataFrame, size: float = S.LIVE_GRID_SIZE) -> DataFrame:
    """Ad-hoc cell report: no filter at all; NULL coordinates form NULL cells."""
    return mean_cells(complaints, size)


def time_rollups(
    complaints: DataFrame,
    *,
    bucket_types: tuple[str, ...] = S.TIME_BUCKETS,
    noise: str | None = "ilike_prefix",
    require_created: bool = True,
    require_coords: bool = False,
    refreshed_at: _dt.datetime | None = None,
) -> DataFrame:
    """hour/day/week x borough x type counts, one scan for all bucket types.

    Canonical: created_date required, coordinates not, ``ilike_prefix``.
    Offline: coordinates required, created_date not (a NULL bucket appears),
    ``contains_ci``.
    """
    preds = []
    if require_created:
        preds.append(F.col("created_date").isNotNull())
    if require_coords:
        preds.append(coords_present())
    if noise:
        preds.append(noise_rule(noise))
    buckets = F.explode(
        F.array(
            *[
                F.struct(F.lit(b).alias("bucket_type"), time_bucket(b, "created_date").alias("bucket_start"))
                for b in bucket_types
            ]
        )
    ).alias("b")
    out = (
        complaints.where(all_of(preds))
        .select("borough", "complaint_type", "created_date", buckets)
        .groupBy(
            F.col("b.bucket_type").alias("bucket_type"),
            F.col("b.bucket_start").alias("bucket_start"),
            "borough",
            "complaint_type",
        )
        .agg(F.count(F.lit(1)).alias("complaint_count"))
    )
    if refreshed_at is not None:
        out = out.withColumn("refreshed_at", _ts(refreshed_at))
    return out


# ---------------------------------------------------------------------------
# Both rollups at once
# ---------------------------------------------------------------------------

GRID_KIND, TIME_KIND = "grid", "time"
STATE_KEYS = ("kind", *_GRID_KEYS, "bucket_type", "bucket_start")
STATE_SUMS = ("complaint_count", *_PART_COLUMNS)


def rollup_copies(complaints: DataFrame, *keep: str) -> DataFrame:
    """One row for each canonical rollup group that a complaint counts in: STATE_KEYS, the parts of its place, its date.

    A complaint with a place has a copy for each zoom level, one with a date a copy
    for each bucket type. ``keep`` names further columns of each copy.
    """
    none = {c: F.lit(None).cast(t).alias(c) for c, t in _KEY_TYPES.items()}
    grids = [
        {"kind": F.lit(GRID_KIND), "zoom_level": F.lit(int(z)), "grid_size_degrees": F.lit(float(g)),
         "lat_bucket": grid_bucket("latitude", float(g)), "lon_bucket": grid_bucket("longitude", float(g))}
        for z, g in S.ZOOM_GRID_SIZES.items()
    ]
    times = [
        {"kind": F.lit(TIME_KIND), "bucket_type": F.lit(b), "bucket_start": time_bucket(b, "created_date")} for b in S.TIME_BUCKETS
    ]
    copies = F.array(*[F.struct(*[c[k].alias(k) if k in c else none[k] for k in _KEY_TYPES]) for c in grids + times])
    rows = complaints.where(noise_rule("ilike_prefix")).select(
        "borough", "complaint_type", "created_date", (F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("_placed"),
        *_coordinates(), *keep, F.explode(copies).alias("_copy"),
    )
    is_grid = F.col("_copy.kind") == GRID_KIND
    rows = rows.where((is_grid & F.col("_placed")) | (~is_grid & F.col("created_date").isNotNull()))
    keys = {k: F.col(f"_copy.{k}") if k in _KEY_TYPES else F.col(k) for k in STATE_KEYS}
    return rows.select(
        *[c.alias(k) for k, c in keys.items()], *[F.when(is_grid, F.col(p)).alias(p) for p in _PART_COLUMNS],
        F.when(is_grid, F.col("created_date")).alias("created_date"), *keep,
    )


_KEY_TYPES = {
    "kind": "string", "zoom_level": "int", "grid_size_degrees": "double", "lat_bucket": "double", "lon_bucket": "double",
    "bucket_type": "string", "bucket_start": "timestamp_ntz",
}


def rollup_state(complaints: DataFrame) -> DataFrame:
    """Both canonical rollups as one frame (STATE_KEYS, exact sums, date range of grid groups): one scan, one shuffle."""
    return rollup_copies(complaints).groupBy(*STATE_KEYS).agg(
        F.count(F.lit(1)).alias("complaint_count"),
        *sum_parts("lat"),
        *sum_parts("lon"),
        F.min("created_date").alias("earliest_created_date"),
        F.max("created_date").alias("latest_created_date"),
    )


def grid_of_state(state: DataFrame, refreshed_at: _dt.datetime) -> DataFrame:
    """The grid rollup of a state, as ``grid_rollups`` gives it."""
    return state.where(F.col("kind") == GRID_KIND).select(
        *_GRID_KEYS, *_centres("complaint_count"), "complaint_count", "earliest_created_date", "latest_created_date",
        _ts(refreshed_at).alias("refreshed_at"),
    )


def time_of_state(state: DataFrame, refreshed_at: _dt.datetime) -> DataFrame:
    """The time rollup of a state, as ``time_rollups`` gives it."""
    return state.where(F.col("kind") == TIME_KIND).select(
        "bucket_type", "bucket_start", "borough", "complaint_type", "complaint_count", _ts(refreshed_at).alias("refreshed_at")
    )


def type_counts(complaints: DataFrame) -> DataFrame:
    """Complaint-type counts over everything, most frequent first."""
    return (
        complaints.groupBy("complaint_type")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc_nulls_first("complaint_type"))
    )
