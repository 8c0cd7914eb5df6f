"""Place codes: the bits of latitude and longitude interleaved (Morton order).

Points that are near have mostly near codes, so a table sorted by the code keeps
each file to a small area. A box of coordinates is a few intervals of codes, which
reach the scan as plain comparisons of one column; the exact comparison of the
coordinates stays beside them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE_CODE = "place_code"
#: bits of each coordinate: cells of 0.0027 x 0.0055 degrees
BITS = 16
#: intervals that a box is covered with at most
MAX_INTERVALS = 32
_RANGES = ((-90.0, 180.0), (-180.0, 360.0))  # least value and extent of latitude and longitude


def _cell(value: float, axis: int) -> int:
    least, extent = _RANGES[axis]
    return int(min(max((value - least) / extent * (1 << BITS) // 1, 0), (1 << BITS) - 1))


def _cell_column(value: Column, axis: int) -> Column:
    least, extent = _RANGES[axis]
    cell = F.floor((value - F.lit(least)) / F.lit(extent) * F.lit(float(1 << BITS)))
    last = F.lit((1 << BITS) - 1)
    # NaN compares as the greatest value, so it lies with the greatest
    return F.when(F.isnan(value), last).otherwise(F.greatest(F.lit(0), F.least(cell, last))).cast("long")


def _spread(cell: Column) -> Column:
    """A zero between each two bits."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        cell = cell.bitwiseOR(F.shiftleft(cell, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return cell


def place_code(lat: str = "latitude", lon: str = "longitude") -> Column:
    """The code of a point; null without both coordinates."""
    at, on = F.col(lat), F.col(lon)
    code = F.shiftleft(_spread(_cell_column(at, 0)), 1).bitwiseOR(_spread(_cell_column(on, 1)))
    return F.when(at.isNotNull() & on.isNotNull(), code).alias(PLACE_CODE)


def box_intervals(box: tuple[float, float, float, float], max_intervals: int = MAX_INTERVALS) -> list[tuple[int, int]]:
    """Code intervals (first, last) that hold every point of a box (least and greatest lat, least and greatest lon).

    Quarters of the plane are split from the largest on while they lie partly
    outside and the intervals are few enough; neighbours join.
    """
    south, north, west, east = (_cell(v, a) for v, a in zip(box, (0, 0, 1, 1), strict=True))
    if south > north or west > east:
        return []
    whole, partly = [], [(0, 0, BITS)]  # (lat cell, lon cell, bits of the side)
    while partly and len(whole) + len(partly) + 3 <= max_intervals:
        partly.sort(key=lambda q: q[2])
        lat, lon, bits = partly.pop()
        for quarter in range(4):
            side = 1 << (bits - 1)
            a, b = lat + side * (quarter >> 1), lon + side * (quarter & 1)
            if a > north or a + side - 1 < south or b > east or b + side - 1 < west:
                continue
            inside = a >= south and a + side - 1 <= north and b >= west and b + side - 1 <= east
            (whole if inside or bits == 1 else partly).append((a, b, bits - 1))
    spans = sorted((_interleaved(a, b), _interleaved(a, b) + (1 << 2 * bits) - 1) for a, b, bits in whole + partly)
    joined: list[tuple[int, int]] = []
    for first, last in spans:
        if joined and first <= joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], max(last, joined[-1][1]))
        else:
            joined.append((first, last))
    return joined


def _interleaved(lat_cell: int, lon_cell: int) -> int:
    return sum(((lat_cell >> i & 1) << 2 * i + 1) | ((lon_cell >> i & 1) << 2 * i) for i in range(BITS))


def place_predicate(min_lat: float | None, max_lat: float | None, min_lon: float | None, max_lon: float | None) -> Column:
    """The code intervals of a box; a bound that is None is open."""
    bounds = (min_lat, max_lat, min_lon, max_lon)
    ends = (-90.0, 90.0, -180.0, 180.0)
    box = tuple(float(e if b is None else b) for b, e in zip(bounds, ends, strict=True))
    code = F.col(PLACE_CODE)
    parts = [(code >= F.lit(a)) & (code <= F.lit(b)) for a, b in box_intervals(box)]
    return reduce(lambda x, y: x | y, parts) if parts else F.lit(False)
