"""Employee x day spine and period bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.operators.common import as_date


def period_bounds(timesheets: DataFrame, as_of=None) -> tuple[Column, Column]:
    """First and last timesheet day as scalar subqueries: no job is started here.

    With ``as_of`` a timesheet dated later is an error that names the row: one wrong year would
    else give every employee a row for each day until then.
    """
    both = F.struct(F.min("work_date").alias("lo"), F.max("work_date").alias("hi"))
    if as_of is not None:
        which = F.max_by("id", "work_date") if "id" in timesheets.columns else F.lit(None)
        text = F.concat(
            F.lit("timesheet "), F.coalesce(which.cast("string"), F.lit("")), F.lit(" is dated "),
            F.max("work_date").cast("string"), F.lit(", after "), as_date(as_of).cast("string"),
        )
        both = F.when(F.max("work_date") > as_date(as_of), F.raise_error(text)).otherwise(both)
    bounds = timesheets.agg(both.alias("bounds")).scalar()
    return bounds.getField("lo"), bounds.getField("hi")


def employee_days(employees: DataFrame, date_from, date_to) -> DataFrame:
    """Every active employee on every day of the period.

    The days are generated inside each employee row, so this is a narrow map over the
    employee table: no cross join and no shuffle.
    """
    days = F.sequence(as_date(date_from), as_date(date_to))
    return employees.where("active").select("*", F.explode(days).alias("work_date"))


def days(spark, date_from, date_to) -> DataFrame:
    """One row per calendar day of the period."""
    return spark.range(1).select(
        F.explode(F.sequence(as_date(date_from), as_date(date_to))).alias("work_date")
    )
