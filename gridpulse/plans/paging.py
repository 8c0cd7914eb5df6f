"""Deep pages by rank selection.

``LIMIT n OFFSET k`` makes one task order k + n rows. Here the first row of the
page is bracketed first: rows are counted by ranges of their date, the range that
holds row k is counted again by ranges 256 times finer, down to the microsecond
and, where very many rows share one, on by the characters of their keys. Each
count is a partial aggregate over the bracket alone, whose date bounds reach the
scan, and the driver gets at most a few thousand counts. The page is then a small
top-k inside the bracket. The following page needs no rank: it seeks behind the
last row of the page before.

Order: created_date descending with NULLs first, then unique_key.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions import ntz_lit

#: rows that a bracket may hold before its page
BRACKET_ROWS = 10_000
#: widths of the date ranges, as powers of two of microseconds: 2.2 years, 76 hours, 18 minutes, 4 seconds ...
_SHIFTS = (46, 38, 30, 22, 14, 6, 0)
_EPOCH = _dt.datetime(1970, 1, 1)


def _at_least(date: Column, micros: int) -> Column:
    """date >= the time of ``micros``, which may lie outside of what a date can be."""
    try:
        return date >= ntz_lit(_EPOCH + _dt.timedelta(microseconds=micros))
    except OverflowError:
        return F.lit(micros < 0)


def _before(date: Column, micros: int) -> Column:
    try:
        return date < ntz_lit(_EPOCH + _dt.timedelta(microseconds=micros))
    except OverflowError:
        return F.lit(micros > 0)


def _holding(counts: list[tuple], rest: int) -> tuple | None:
    """(bucket, rows, rows of it before) of the bucket that holds row ``rest``; None beyond the last row."""
    for bucket, n in counts:
        if rest < n:
            return bucket, n, rest
        rest -= n
    return None


def _counts(rows: DataFrame, bucket: Column) -> list[tuple]:
    return [tuple(r) for r in rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()]


def rank_bracket(
    rows: DataFrame, offset: int, bound: int = BRACKET_ROWS, date: str = "created_date", key: str = "unique_key"
) -> tuple[Column, int]:
    """(predicate, rest): the rows from the bracket that holds row ``offset`` on, and the row's place among them.

    ``rest`` is below ``bound``, but where more rows than that agree in date and
    key. Beyond the last row the predicate keeps nothing.
    """
    at, name = F.col(date), F.col(key)
    micros = F.timestamp_diff("MICROSECOND", ntz_lit(_EPOCH), at)
    within, rest, same, later = rows, offset, None, None
    for shift in _SHIFTS:
        counts = _counts(within, F.shiftright(micros, shift))
        found = _holding(sorted(counts, key=lambda c: (c[0] is not None, -(c[0] or 0))), rest)
        if found is None:
            return F.lit(False), 0
        bucket, n, rest = found
        if bucket is None:
            same, later = at.isNull(), at.isNotNull()
            if n <= bound:
                return F.lit(True), rest  # NULL dates come first, nothing is before them
            break
        low, high = bucket << shift, (bucket + 1) << shift
        if n <= bound:
            return _before(at, high), rest
        same, later = _at_least(at, low) & _before(at, high), _before(at, low)
        within = rows.where(same)
    # more rows than that in one microsecond, or without a date: on by their keys
    prefix = ""
    within = rows.where(same)
    while True:
        size = len(prefix) + 1
        counts = _counts(within, F.substring(name, 1, size))
        bucket, n, rest = _holding(sorted(counts, key=lambda c: (c[0] is not None, c[0] or "")), rest)
        if bucket is None:
            return same | later, rest
        if n <= bound or len(bucket) < size:
            return (same & (name >= F.lit(bucket))) | later, rest
        prefix = bucket
        within = rows.where(same & name.startswith(prefix))


def behind(last_date: _dt.datetime | None, last_key: str, date: str = "created_date", key: str = "unique_key") -> Column:
    """The rows that follow a page's last row."""
    at, name = F.col(date), F.col(key)
    if last_date is None:
        return (at.isNull() & (name > F.lit(last_key))) | at.isNotNull()
    limit = ntz_lit(last_date)
    return (at <= limit) & ((at < limit) | (name > F.lit(last_key)))
