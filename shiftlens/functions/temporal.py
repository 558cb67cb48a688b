"""Instants, days and the split of a span over the days it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from start to end, truncated toward zero."""
    return F.timestamp_diff("MINUTE", start, end)


def day_start(day: Column) -> Column:
    return day.cast("timestamp")


def explode_days(
    df: DataFrame,
    first: Column,
    last: Column,
    day: str = "work_date",
    date_from: Column | None = None,
    date_to: Column | None = None,
) -> DataFrame:
    """One row per calendar day in [first, last]; rows whose last < first, or that lack one of
    them, vanish.

    With bounds, spans outside the period are dropped before the explode and the
    others are clipped, so a very long span costs only the days asked for.
    """
    lo = first if date_from is None else F.greatest(first, date_from)
    hi = last if date_to is None else F.least(last, date_to)
    return (
        df.where(first.isNotNull() & last.isNotNull())
        .withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .where(F.col("_lo") <= F.col("_hi"))
        .withColumn(day, F.explode(F.sequence("_lo", "_hi")))
        .drop("_lo", "_hi")
    )


def minutes_on_day(start: Column, end: Column, day: Column) -> Column:
    """Whole minutes of [start, end] that fall on ``day``."""
    begin = F.greatest(start, day_start(day))
    finish = F.least(end, day_start(F.date_add(day, 1)))
    return minutes_between(begin, finish)


def is_single_day(start: Column, end: Column) -> Column:
    return F.to_date(start) == F.to_date(end)


# Accepted spellings, day first or year first, the time of day optional.
# Each pattern holds several formats, so a text is named twice only, not once per format.
DATETIME_FORMATS = ["d/M/yyyy[ H:mm[:ss]]", "yyyy-M-d[ H:mm[:ss]]"]
DATE_FORMATS = ["d/M/yyyy[ H:mm]", "yyyy-M-d[ H:mm:ss]"]
TIME_FORMAT = "d/M/yyyy H:mm"


def parse_datetime(text: Column) -> Column:
    """First format that fits; blank or unreadable text gives NULL, no time means midnight."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in DATETIME_FORMATS])


def parse_date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in DATE_FORMATS]).cast("date")


def parse_time(text: Column) -> Column:
    """``HH:mm:ss`` taken from a day/month/year hour:minute text."""
    return F.date_format(F.try_to_timestamp(F.trim(text), F.lit(TIME_FORMAT)), "HH:mm:ss")
