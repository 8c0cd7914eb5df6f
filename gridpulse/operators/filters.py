"""Row predicates and argument checks.

``complaint_filter`` builds one conjunctive Column from optional
parameters. As in the reference, an empty string means "not given" while a
numeric 0 is a real bound; the borough parameter is upper-cased, the data
is not.
"""

from __future__ import annotations

import datetime as _dt
import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridpulse import schema as S
from gridpulse.functions import is_finite, ntz_lit, parse_iso_param


@dataclass(frozen=True)
class ComplaintFilter:
    """Filter parameters shared by the points, grid and overview queries."""

    start_date: _dt.datetime | str | None = None
    end_date: _dt.datetime | str | None = None
    borough: str | None = None
    complaint_type: str | None = None
    descriptor: str | None = None
    min_lat: float | None = None
    max_lat: float | None = None
    min_lon: float | None = None
    max_lon: float | None = None

    def dates(self) -> tuple[_dt.datetime | None, _dt.datetime | None]:
        return _as_datetime(self.start_date), _as_datetime(self.end_date)

    def has_date_bound(self) -> bool:
        start, end = self.dates()
        return start is not None or end is not None

    def bbox(self) -> tuple[float | None, float | None, float | None, float | None]:
        return self.min_lat, self.max_lat, self.min_lon, self.max_lon


def _as_datetime(value: _dt.datetime | str | None) -> _dt.datetime | None:
    if isinstance(value, _dt.datetime):
        return value
    return parse_iso_param(value)


def all_of(predicates: list[Column]) -> Column:
    if not predicates:
        return F.lit(True)
    return functools.reduce(operator.and_, predicates)


def coords_present(lat: str = "latitude", lon: str = "longitude") -> Column:
    return F.col(lat).isNotNull() & F.col(lon).isNotNull()


def bbox_predicates(
    min_lat: float | None,
    max_lat: float | None,
    min_lon: float | None,
    max_lon: float | None,
    lat: str = "latitude",
    lon: str = "longitude",
) -> list[Column]:
    """Inclusive bounds; each side optional (``None`` = not given, 0 = given)."""
    preds = []
    if min_lat is not None:
        preds.append(F.col(lat) >= F.lit(float(min_lat)))
    if max_lat is not None:
        preds.append(F.col(lat) <= F.lit(float(max_lat)))
    if min_lon is not None:
        preds.append(F.col(lon) >= F.lit(float(min_lon)))
    if max_lon is not None:
        preds.append(F.col(lon) <= F.lit(float(max_lon)))
    return preds


def category_predicates(borough: str | None, complaint_type: str | None, descriptor: str | None = None) -> list[Column]:
    preds = []
    if borough:
        preds.append(F.col("borough") == F.lit(borough.upper()))
    if complaint_type:
        preds.append(F.col("complaint_type") == F.lit(complaint_type))
    if descriptor:
        preds.append(F.col("descriptor") == F.lit(descriptor))
    return preds


def date_predicates(start: _dt.datetime | None, end: _dt.datetime | None, col: str = "created_date") -> list[Column]:
    """Inclusive at both ends; NULL dates drop out once a bound is given."""
    preds = []
    if start is not None:
        preds.append(F.col(col) >= ntz_lit(start))
    if end is not None:
        preds.append(F.col(col) <= ntz_lit(end))
    return preds


def complaint_filter(
    flt: ComplaintFilter,
    *,
    lat: str = "latitude",
    lon: str = "longitude",
    use_descriptor: bool = True,
    use_bbox: bool = True,
    use_type: bool = True,
) -> Column:
    """Coordinates present + every given parameter, AND-ed."""
    start, end = flt.dates()
    preds = [coords_present(lat, lon)]
    preds += date_predicates(start, end)
    preds += category_predicates(
        flt.borough,
        flt.complaint_type if use_type else None,
        flt.descriptor if use_descriptor else None,
    )
    if use_bbox:
        preds += bbox_predicates(*flt.bbox(), lat=lat, lon=lon)
    return all_of(preds)


def finite_coords(lat: str = "lat", lon: str = "lon") -> Column:
    return is_finite(lat) & is_finite(lon)


def lookback(as_of: _dt.datetime, days: int = S.LOOKBACK_DAYS, col: str = "created_date") -> Column:
    """``created_date >= as_of - days``; ``as_of`` is an argument, never the clock."""
    return F.col(col) >= ntz_lit(as_of - _dt.timedelta(days=days))


# ---------------------------------------------------------------------------
# Argument checks (raise ValueError like the service's 4xx answers)
# ---------------------------------------------------------------------------


def check_limit(limit: int | None, *, max_limit: int = S.MAX_LIMIT) -> int:
    if limit is None:
        limit = S.DEFAULT_LIMIT
    if not 1 <= limit <= S.MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {S.MAX_LIMIT}; got {limit}")
    return min(max(limit, 1), max_limit)


def check_offset(offset: int | None) -> int:
    offset = 0 if offset is None else offset
    if offset < 0:
        raise ValueError(f"offset must be >= 0; got {offset}")
    return offset


def check_min_count(min_count: int | None) -> int:
    min_count = 1 if min_count is None else min_count
    if min_count < 1:
        raise ValueError(f"min_count must be >= 1; got {min_count}")
    return min_count


def check_zoom(zoom_level: int | None) -> int | None:
    if zoom_level is not None and not 1 <= zoom_level <= 22:
        raise ValueError(f"zoom_level must be between 1 and 22; got {zoom_level}")
    return zoom_level


def check_bucket_type(bucket_type: str | None) -> str:
    bucket_type = bucket_type or "day"
    if bucket_type not in S.TIME_BUCKETS:
        raise ValueError(f"bucket_type must be one of {', '.join(S.TIME_BUCKETS)}; got {bucket_type!r}")
    return bucket_type


def check_timeseries_limit(limit: int | None) -> int:
    limit = S.TIMESERIES_DEFAULT_LIMIT if limit is None else limit
    if not 1 <= limit <= S.TIMESERIES_MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {S.TIMESERIES_MAX_LIMIT}; got {limit}")
    return limit
