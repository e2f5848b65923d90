"""Times as their owner lived them: days, hours, weekdays and months of a zone, from ISO-8601 texts in UTC or with an offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
_ZONED = r"(?:[zZ]|[+-]\d{2}:?\d{2})$"


def local(ts: Column, zone: str | None = None) -> Column:
    """The wall clock (a timestamp without zone) of an instant in a zone, the session's if none is named; a text without an offset is a wall clock already. Null if it is no time."""
    instant = ts.try_cast("timestamp").cast("timestamp_ntz")  # in the session's zone, whatever that is
    there = F.convert_timezone(F.current_timezone(), F.lit(zone), instant) if zone else instant
    return F.when(ts.rlike(_ZONED), there).otherwise(ts.try_cast("timestamp_ntz"))


def local_date(ts: Column, zone: str | None = None) -> Column:
    """The calendar day; of a text that is no time, the date that it begins with, if that is one."""
    head = F.when(ts.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(ts, 1, 10)).try_cast("date")
    return F.coalesce(local(ts, zone).cast("date"), head)


def local_hour(ts: Column, zone: str | None = None) -> Column:
    """The hour; null for a bare date, which has none."""
    return F.when(F.length(ts) > 10, F.hour(local(ts, zone)))


def weekday(day: Column) -> Column:
    """Mon to Sun."""
    return F.date_format(day, "E")


def month(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(UNKNOWN))
