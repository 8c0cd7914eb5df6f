"""Sums and means of doubles that don't depend on the order of the rows.

A double sum rounds after each addition, so its last bits follow the order in
which partial sums meet. Here a value is split into three whole numbers, its
digits in steps of 2 ** -17, 2 ** -43 and 2 ** -69; their sums are exact bigints,
which add up, subtract and merge in any order. Every double of magnitude 2 ** -16
to 2 ** 9 is split without loss (all coordinates in degrees but those within
0.00002 of zero, which are cut to a multiple of 2 ** -69). Up to 2 ** 36 values
fit in a sum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: magnitudes from here on, NaN and infinities aren't split; they are summed as doubles
LIMIT = 512.0
HIGH, STEP = 17, 26
_UNIT = 1 << STEP
#: names of the parts of a sum: three digits, and the values beyond LIMIT
PARTS = ("hi", "mid", "lo", "odd")


def _is_odd(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) >= F.lit(LIMIT))


def split(value: Column, name: str) -> list[Column]:
    """The columns ``<name>_hi``, ``_mid``, ``_lo`` (bigint) and ``_odd`` (double) of one value; all null for a null."""
    whole = F.when(~_is_odd(value), value * F.lit(float(1 << HIGH)))
    hi = F.floor(whole)
    rest = (whole - hi) * F.lit(float(_UNIT))
    mid = F.floor(rest)
    lo = F.floor((rest - mid) * F.lit(float(_UNIT)))
    odd = F.when(_is_odd(value), value)
    return [c.alias(f"{name}_{p}") for c, p in zip((hi, mid, lo, odd), PARTS, strict=True)]


def sum_parts(name: str, sign: Column | None = None) -> list[Column]:
    """Aggregates: the sum of each part of ``name``, negated where ``sign`` is -1."""
    return [F.sum(F.col(f"{name}_{p}") * sign if sign is not None else F.col(f"{name}_{p}")).alias(f"{name}_{p}") for p in PARTS]


def mean_of(name: str, count: Column) -> Column:
    """The mean, rounded once, of ``count`` values whose parts sum to ``<name>_hi`` and so on; null for none.

    Long division digit by digit: the quotient's digits of 2 ** -17 and 2 ** -43
    are exact as one double, the last one is rounded into it.
    """
    hi, mid, lo, odd = (F.col(f"{name}_{p}") for p in PARTS)
    unit = F.lit(_UNIT)

    def floor_div(a: Column, b: Column) -> Column:
        return F.call_function("div", a - F.pmod(a, b), b)  # pmod is the floor's rest for b > 0, so nothing is cut

    carried_mid = mid + F.shiftright(lo, STEP)
    carried_hi = hi + F.shiftright(carried_mid, STEP)
    low, middle = F.pmod(lo, unit), F.pmod(carried_mid, unit)
    rest = F.pmod(carried_hi, count)
    second = rest * unit + middle
    third = F.pmod(second, count) * unit + low
    digits = [(floor_div(carried_hi, count), HIGH), (floor_div(second, count), HIGH + STEP), (floor_div(third, count), HIGH + 2 * STEP)]
    exact = reduce(lambda a, b: a + b, [d.cast("double") * F.lit(2.0**-k) for d, k in digits])
    return F.when(odd.isNotNull(), (odd + F.coalesce(exact, F.lit(0.0)) * count) / count).otherwise(exact)
