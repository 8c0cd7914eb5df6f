"""Ingest normalisation: text records -> typed complaint records.

Three contracts, as in the reference:

* producer / scheduled sync validation: keep a row only if its stripped
  complaint type contains "Noise" (case-sensitive), its key is non-empty
  and both coordinates are non-empty;
* sync: after validation every value must parse, or the whole job fails
  (``raise_error`` at execution, independent of the ANSI setting);
* stream consumer: no noise test, no trim; '' or missing coordinates and
  dates become NULL and the row is kept; a missing key or an unparsable
  date/coordinate rejects the row, which goes to a side output with its
  reason instead of being lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse import schema as S
from gridpulse.functions import iso_timestamp, noise_rule, py_strip, text_to_double

REJECT_COLUMN = "reject_reason"
# Reject reasons, in the order the checks run.
REJECT_REASONS = ("undecodable", "missing_key", "bad_created_date", "bad_closed_date", "bad_latitude", "bad_longitude")


def _given(c: Column) -> Column:
    """Value present and not the empty string (Python truthiness of text)."""
    return c.isNotNull() & (c != F.lit(""))


def publish_filter() -> Column:
    """Producer / sync validation (rows failing it are silently dropped)."""
    return (
        noise_rule("contains_cs")
        & _given(F.col("unique_key"))
        & _given(F.col("latitude"))
        & _given(F.col("longitude"))
    )


def _strict(raw: Column, parsed: Column, what: str) -> Column:
    bad = _given(raw) & parsed.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit(f"sync failed: cannot parse {what} from "), raw))).otherwise(parsed)


def _typed_columns(dates: dict[str, Column], coords: dict[str, Column], complaint_type: Column) -> list[Column]:
    out = []
    for c in S.BUSINESS_COLUMNS:
        if c in dates:
            out.append(dates[c].alias(c))
        elif c in coords:
            out.append(coords[c].alias(c))
        elif c == "complaint_type":
            out.append(complaint_type.alias(c))
        elif c == "unique_key":
            out.append(F.col(c).cast("string").alias(c))
        else:
            out.append(F.col(c))
    return out


def normalize_sync(extract: DataFrame, source: str = S.SYNC_SOURCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scheduled-sync normalisation: validate, strip the type, parse strictly."""
    dates = {c: _strict(F.col(c), iso_timestamp(F.col(c)), c) for c in S.DATE_COLUMNS}
    coords = {c: _strict(F.col(c), text_to_double(F.col(c)), c) for c in S.COORD_COLUMNS}
    return extract.where(publish_filter()).select(
        *keep,
        *_typed_columns(dates, coords, py_strip(F.col("complaint_type"))),
        F.lit(source).alias("source"),
    )


def encode_messages(extract: DataFrame, source: str = S.PRODUCER_SOURCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Producer: validate, strip the type, emit one JSON text per record.

    Values stay text (coordinates too); absent fields are written as null.
    """
    fields = [
        (py_strip(F.col(c)) if c == "complaint_type" else F.col(c).cast("string")).alias(c) for c in S.BUSINESS_COLUMNS
    ]
    payload = F.struct(*fields, F.lit(source).alias("source"))
    return extract.where(publish_filter()).select(
        *keep, F.to_json(payload, {"ignoreNullFields": "false"}).alias("value")
    )


def reject_reason(decoded: Column | None = None) -> Column:
    """First failing consumer check, or NULL for a good message."""
    expr = F.when(~decoded, F.lit("undecodable")) if decoded is not None else None

    def add(cond: Column, name: str) -> None:
        nonlocal expr
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))

    add(F.col("unique_key").isNull(), "missing_key")
    for c in S.DATE_COLUMNS:
        add(_given(F.col(c)) & iso_timestamp(F.col(c)).isNull(), f"bad_{c}")
    for c in S.COORD_COLUMNS:
        add(_given(F.col(c)) & text_to_double(F.col(c)).isNull(), f"bad_{c}")
    return expr


def normalize_stream(messages: DataFrame, keep: tuple[str, ...] = (), decoded: Column | None = None) -> DataFrame:
    """Consumer normalisation: typed record columns + ``reject_reason``.

    ``reject_reason`` is NULL for a good row; ``decoded`` (optional) is
    False for a message whose JSON could not be read at all.
    """
    dates = {c: iso_timestamp(F.col(c)) for c in S.DATE_COLUMNS}
    coords = {c: text_to_double(F.col(c)) for c in S.COORD_COLUMNS}
    return messages.select(
        *keep,
        *_typed_columns(dates, coords, F.col("complaint_type")),
        F.coalesce(F.col("source"), F.lit(S.STREAM_DEFAULT_SOURCE)).alias("source"),
        reject_reason(decoded).alias(REJECT_COLUMN),
    )


def valid_rows(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col(REJECT_COLUMN).isNull()).drop(REJECT_COLUMN)


def rejected_rows(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col(REJECT_COLUMN).isNotNull())


RAW_REJECT_COLUMNS = ("unique_key", "created_date", "closed_date", "latitude", "longitude")


def raw_rejects(messages: DataFrame, keep: tuple[str, ...] = (), decoded: Column | None = None) -> DataFrame:
    """Rejected messages with their raw text and the reason (the side output)."""
    return (
        messages.select(*keep, *RAW_REJECT_COLUMNS, reject_reason(decoded).alias(REJECT_COLUMN))
        .where(F.col(REJECT_COLUMN).isNotNull())
    )
