"""Text to typed values, as the ingest paths and query parameters need it.

Timestamps are stored zone-less (``TIMESTAMP_NTZ``). Text with a zone
suffix (``Z``, ``+05:00``) is moved to UTC wall-clock time; text without a
suffix keeps its wall clock. Both are done with zone-free arithmetic, so
the result does not depend on the session time zone.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The common form, which one cast parses: a date, or a date and a time with seconds.
_PLAIN = r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?$"
# Dates 2024-01-05 or 20240105; any separator; times hh[:mm[:ss[.fff]]] or hhmm[ss[.fff]]; zones Z, +hh[[:]mm].
_ISO = (
    r"^(\d{4}-\d{2}-\d{2}|\d{8})"
    r"(?:[^\d](\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}|\d{6}(?:[.,]\d+)?)"
    r"(Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d)?)?)?$"
)
_BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_PLAIN_NUMBER = r"^-?\d{1,15}(?:\.\d{1,15})?$"  # the common form: one test and one cast
_NUMBER = (
    r"^[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?$"
    r"|^[+-]?(?i:inf|infinity|nan)$"
)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_blanks(c: Column) -> Column:
    """Without leading and trailing blanks of any kind, no-break spaces too."""
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")


def iso_timestamp(c: Column) -> Column:
    """ISO-8601 text -> TIMESTAMP_NTZ in UTC wall time; '' and junk -> NULL.

    Anchored: text around the date, a year or month alone, one-digit fields, zone
    names and a lower-case z are junk. Extended and compact dates, with or without
    a time and a numeric zone, are read; ISO week dates (2024-W01-1) are not.
    Text of the common form costs one cast; the other forms are brought to it first.
    """
    s = empty_to_null(c)
    date = F.regexp_replace(F.regexp_extract(s, _ISO, 1), "-", "")
    clock = F.regexp_replace(F.regexp_replace(F.regexp_extract(s, _ISO, 2), ":", ""), ",", ".")
    zone = F.regexp_replace(F.regexp_extract(s, _ISO, 3), ":", "")
    field = lambda text, at: F.when(F.length(text) >= at + 1, F.substring(text, at, 2)).otherwise(F.lit("00"))
    wall = F.concat(
        F.substring(date, 1, 4), F.lit("-"), F.substring(date, 5, 2), F.lit("-"), F.substring(date, 7, 2), F.lit(" "),
        field(clock, 1), F.lit(":"), field(clock, 3), F.lit(":"), field(clock, 5), F.substring(clock, 7, 7),
    )
    sign = F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    minutes = 60 * F.coalesce(F.substring(zone, 2, 2).try_cast("int"), F.lit(0)) + F.coalesce(
        F.substring(zone, 4, 2).try_cast("int"), F.lit(0)
    )
    shifted = F.timestamp_add("MINUTE", -sign * minutes, wall.try_cast("timestamp_ntz"))
    return F.when(s.rlike(_PLAIN), s.try_cast("timestamp_ntz")).when(s.rlike(_ISO), shifted)


def ntz_lit(value: _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal with exactly this wall-clock time.

    ``F.lit(datetime)`` makes a session-zone TIMESTAMP from the Python
    process's zone; casting it shifts the value whenever the two zones
    differ. Going through ISO text is zone-free.
    """
    if value.tzinfo is not None:
        value = value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def text_to_double(c: Column) -> Column:
    """Decimal text -> double; '' -> NULL; junk -> NULL (callers decide skip/fail).

    Blanks around the number, digit groups (1_000), exponents, inf and nan are
    read; type suffixes (40.5d) and hexadecimal text are junk.
    """
    plain = empty_to_null(c)
    s = strip_blanks(plain)
    other = F.when(s.rlike(_NUMBER), F.regexp_replace(s, "_", "").try_cast("double"))
    return F.when(plain.rlike(_PLAIN_NUMBER), plain.try_cast("double")).otherwise(other)


def parse_iso_param(value: str | None) -> _dt.datetime | None:
    """Query parameter: empty/None = not given; bad text raises ``ValueError``.

    Aware values are moved to UTC and made naive, like the data.
    """
    if not value:
        return None
    try:
        parsed = _dt.datetime.fromisoformat(value)
    except ValueError as exc:
        raise ValueError(f"Invalid datetime: {value}") from exc
    if parsed.tzinfo is not None:
        parsed = parsed.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    return parsed
