"""Partials per day that answer for any period, and totals at several grains in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftlens.operators.common import within

# ---------------------------------------------------------------- distinct members, by bitmaps


def daily_bitmaps(rows: DataFrame, group: str, member: str, day: str = "work_date") -> DataFrame:
    """(group, day, bucket, members): exact bitmaps of the members seen per group and day.

    A bitmap holds 32,768 ids; ``bucket`` says which.  Partials of tasks are united before the
    shuffle, and stored partials of days are all that a distinct count of any period has to read.
    """
    seen = rows.where(F.col(group).isNotNull() & F.col(member).isNotNull() & F.col(day).isNotNull())
    return seen.groupBy(group, F.col(day).alias("work_date"), F.bitmap_bucket_number(member).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(member)).alias("members")
    )


def distinct_in_period(bitmaps: DataFrame, group: str, date_from=None, date_to=None) -> DataFrame:
    """(group, members): how many different members a group had in a period."""
    days = bitmaps.where(within("work_date", date_from, date_to))
    united = days.groupBy(group, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("members")).alias("n"))
    return united.groupBy(group).agg(F.sum("n").alias("members"))


def distinct_in_windows(bitmaps: DataFrame, group: str, lengths: list[int]) -> DataFrame:
    """(group, day, members_<n> ..): different members of the last n days, for every day from the
    group's first to the last day of all.

    A window frame unites the bitmaps of its days; days without rows are put in as empty ones, so
    every day has its count.  The bitmaps are shuffled once for all lengths.
    """
    last = bitmaps.agg(F.max("work_date")).scalar()
    spans = bitmaps.groupBy(group, "bucket").agg(F.min("work_date").alias("first"))
    every = spans.select(group, "bucket", F.explode(F.sequence("first", last)).alias("work_date"))
    rows = bitmaps.select(group, "bucket", "work_date", "members").unionByName(every, allowMissingColumns=True)
    rows = rows.withColumn("at", F.unix_date("work_date"))

    def united(n: int) -> Column:
        frame = Window.partitionBy(group, "bucket").orderBy("at").rangeBetween(1 - n, 0)
        return F.bitmap_count(F.bitmap_or_agg("members").over(frame)).alias(f"members_{n}")

    # A day has two rows where it has a bitmap; both see the whole day.
    counted = rows.select(group, "bucket", "work_date", *[united(n) for n in lengths]).distinct()
    return counted.groupBy(group, "work_date").agg(*[F.sum(f"members_{n}").alias(f"members_{n}") for n in lengths])


# ---------------------------------------------------------------- totals at several grains


def grain_name(columns: list[str]) -> str:
    return "_".join(columns) or "all"


def kpi_rollup(kpi: DataFrame, grains: list[list[str]] | None = None) -> DataFrame:
    """Totals of KPI rows per day, month, employee, employee and month, and of all, in one pass.

    Columns: grain, employee_id, month, work_date (NULL where the grain has none), days, and the
    sums.  Spark expands each row into its grains and adds up before the one exchange.
    """
    grains = grains or [["work_date"], ["month"], ["employee_id"], ["employee_id", "month"], []]
    columns = ["employee_id", "month", "work_date"]
    rows = kpi.withColumn("month", F.trunc("work_date", "month"))

    def is_grain(grain: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.grouping(c) == (0 if c in grain else 1) for c in columns])

    name = F.lit(None).cast("string")
    for grain in grains:
        name = F.when(is_grain(grain), grain_name(grain)).otherwise(name)
    sums = ["timesheet_hours", "billable_hours", "revenue", "daily_cost", "profit_loss", "remote_sessions", "vehicle_usage"]
    return rows.groupingSets([[F.col(c) for c in g] for g in grains], *columns).agg(
        name.alias("grain"),
        F.count(F.lit(1)).alias("days"),
        *[F.sum(s).alias(s) for s in sums],
        F.min("efficiency_rate").alias("least_efficiency"),
        F.max("efficiency_rate").alias("best_efficiency"),
    )
