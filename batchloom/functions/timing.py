"""Points in time and the distances between them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F


def moment(value: Column | str | datetime) -> Column:
    """A point in time given as column, ISO text or datetime; without zone it stays so."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            return F.lit(value)
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def minutes_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / 60


def days_before(as_of: Column, days: float) -> Column:
    return as_of - F.make_dt_interval(days=F.lit(int(days)))


def hours_before(as_of: Column, hours: int) -> Column:
    return as_of - F.make_dt_interval(hours=F.lit(hours))


def add_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def iso_text(ts: Column) -> Column:
    """ISO-8601 text; the fraction appears only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
