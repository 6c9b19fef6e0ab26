"""Times as microseconds since 1970 in UTC, independent of the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: date, optional time, optional fraction, optional zone
_ISO = r"^\s*(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2})?)(?:[.,](\d{1,9}))?)?\s*(?:Z|z|UTC|([+-])(\d{2}):?(\d{2}))?\s*$"


def micros(c: Column) -> Column:
    """Microseconds of a time without zone, read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def iso_micros(c: Column) -> Column:
    """Microseconds of an ISO-8601 text; without zone it is UTC, unreadable text gives null."""
    part = lambda i: F.nullif(F.regexp_extract(c, _ISO, i), F.lit(""))
    local = F.try_to_timestamp(F.concat(part(1), F.lit(" "), F.rpad(F.coalesce(part(2), F.lit("00:00:00")), 8, ":00"), F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ssX"))
    fraction = F.coalesce(F.rpad(part(3), 6, "0").cast("bigint"), F.lit(0))
    offset = F.coalesce(part(5).cast("bigint") * 60 + part(6).cast("bigint"), F.lit(0)) * F.when(part(4) == "-", -60_000_000).otherwise(60_000_000)
    return F.unix_micros(local) + fraction - offset


def utc_text(us: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of microseconds since 1970, fractions cut off."""
    seconds = F.floor(us / F.lit(1_000_000)).cast("bigint")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / F.lit(86_400)).cast("int"))
    rest = F.pmod(seconds, F.lit(86_400))
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(F.pmod(rest, F.lit(3600)) / 60)), F.lit(":"), two(F.pmod(rest, F.lit(60))))


def iso_or(c: Column, now_micros: int, days: int = 30) -> Column:
    """``iso_micros``, or so many days before now for unreadable and missing text."""
    return F.coalesce(iso_micros(c), F.lit(now_micros - days * 86_400_000_000))
