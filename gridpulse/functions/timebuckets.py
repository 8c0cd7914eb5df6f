"""hour / day / week buckets of a TIMESTAMP_NTZ column.

``date_trunc`` turns zone-less input into a session-zone TIMESTAMP; these
forms stay zone-less and give the same wall-clock buckets in any session
time zone. Weeks start on Monday.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_bucket(bucket_type: str, ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    day = F.to_date(c)
    if bucket_type == "hour":
        return F.timestamp_add("HOUR", F.hour(c), day.cast("timestamp_ntz"))
    if bucket_type == "day":
        return day.cast("timestamp_ntz")
    if bucket_type == "week":
        return F.trunc(day, "week").cast("timestamp_ntz")
    if bucket_type == "minute":
        return F.timestamp_add("MINUTE", F.minute(c), time_bucket("hour", c))
    if bucket_type == "second":
        return F.timestamp_add("SECOND", F.second(c), time_bucket("minute", c))
    raise ValueError(f"bucket_type must be one of hour, day, week (or minute, second); got {bucket_type!r}")
