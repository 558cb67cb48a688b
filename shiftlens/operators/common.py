"""Small pieces shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def as_date(value) -> Column | None:
    """A date bound given as ``None``, a date, an ISO string or a Column."""
    if value is None or isinstance(value, Column):
        return value
    return F.lit(value).cast("date")


def within(column: str | Column, date_from=None, date_to=None) -> Column:
    """Optional lower and upper bound, ANDed; always true without bounds."""
    col = F.col(column) if isinstance(column, str) else column
    conditions = []
    if date_from is not None:
        conditions.append(col >= as_date(date_from))
    if date_to is not None:
        conditions.append(col <= as_date(date_to))
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _day_after(value) -> Column:
    return F.date_add(as_date(value), 1).cast("timestamp")


def starts_within(column: str, date_from=None, date_to=None) -> Column:
    """Like ``within`` for the day of a timestamp, as bounds on the timestamp itself: a scan
    can skip row groups by them."""
    conditions = []
    if date_from is not None:
        conditions.append(F.col(column) >= as_date(date_from).cast("timestamp"))
    if date_to is not None:
        conditions.append(F.col(column) < _day_after(date_to))
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def meets(start: str, end: str, date_from=None, date_to=None) -> Column:
    """Spans that may touch the period; those without an end are kept."""
    conditions = []
    if date_from is not None:
        conditions.append(F.col(end).isNull() | (F.col(end) >= as_date(date_from).cast("timestamp")))
    if date_to is not None:
        conditions.append(F.col(start) < _day_after(date_to))
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def filtered(
    df: DataFrame, employee_id=None, date_from=None, date_to=None, day: str = "work_date"
) -> DataFrame:
    """Employee and period filters of every report; conditions that are not given are left out."""
    out = df
    if employee_id is not None:
        out = out.where(F.col("employee_id") == employee_id)
    if date_from is not None or date_to is not None:
        out = out.where(within(day, date_from, date_to))
    return out


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def union_all(frames: list[DataFrame], fill: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), frames)


def active_only(employees: DataFrame) -> DataFrame:
    return employees.where("active")
