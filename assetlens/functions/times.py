"""Instants kept as ISO text, and their Julian days as doubles."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds from the start of the Julian day count to the Unix epoch, milliseconds of a day, and seconds from the
#: Unix epoch to 2001-01-01.
JULIAN_EPOCH_MS = 210866760000000
DAY_MS = 86400000.0
CORE_DATA_EPOCH = 978307200


def instant(text: Column) -> Column:
    """Timestamp of ISO text with offset; null where the text is blank or no date."""
    return F.try_to_timestamp(text)


def millis(text: Column) -> Column:
    return F.floor(F.unix_micros(instant(text)) / 1000).cast("bigint")


def julian_day(text: Column) -> Column:
    """Fractional Julian day, to the millisecond below."""
    return (millis(text) + F.lit(JULIAN_EPOCH_MS)).cast("double") / F.lit(DAY_MS)


def seconds_apart(a: Column, b: Column) -> Column:
    """Distance of two Julian days in seconds, in doubles."""
    return F.abs((a - b) * F.lit(86400.0))


def core_data_time(seconds: Column) -> Column:
    """ISO text of seconds since 2001-01-01, fraction dropped; blank where null."""
    at = F.timestamp_seconds(F.lit(CORE_DATA_EPOCH) + F.when(seconds >= 0, F.floor(seconds)).otherwise(F.ceil(seconds)).cast("bigint"))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def parse_bound(name: str, text: str) -> datetime:
    """An RFC 3339 instant; anything without a time and an offset is an error."""
    try:
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError as e:
        raise ValueError(f"{name} must be an RFC3339 timestamp") from e
    if at.tzinfo is None or "T" not in text.upper():
        raise ValueError(f"{name} must be an RFC3339 timestamp")
    return at.astimezone(timezone.utc)
