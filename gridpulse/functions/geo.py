"""Grid cell arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def grid_bucket(coord: Column | str, size: Column | float) -> Column:
    """Lower edge of the grid cell: ``FLOOR(coord / size) * size`` as a double.

    A true floor (towards minus infinity), so -74.0001 with size 0.01 falls in
    cell -7401. The quotient is plain IEEE division, never rounded first.
    NaN and +/- infinity stay themselves (Spark's FLOOR returns a bigint,
    which would turn NaN into cell 0), as SQL FLOOR on a double does.
    """
    c = _col(coord)
    g = size if isinstance(size, Column) else F.lit(float(size))
    non_finite = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(non_finite, c).otherwise((F.floor(c / g) * g).cast("double"))


def is_finite(coord: Column | str) -> Column:
    """Drops NULL, NaN and +/- infinity."""
    c = _col(coord)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
