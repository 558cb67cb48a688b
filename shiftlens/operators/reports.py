"""Reports over KPI rows and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.functions import numeric as N, temporal as T
from shiftlens.functions.text import severity_rank
from shiftlens.operators.common import as_date, count_where, filtered, within
from shiftlens.operators.spine import days
from shiftlens.operators.validators import absence_days
from shiftlens.settings import Settings

KEYS = ["employee_id", "work_date"]


def _sum(column: str, kind: str = "decimal(18,2)") -> Column:
    return F.coalesce(F.sum(column), F.lit(0).cast(kind))


def kpi_summary(kpi: DataFrame, employee_id=None, date_from=None, date_to=None) -> DataFrame:
    """One row of totals and means over an optional employee and period."""
    k = filtered(kpi, employee_id, date_from, date_to)
    zero = F.lit(0.0)
    out = k.agg(
        F.coalesce(N.exact_avg(F.col("efficiency_rate")), zero).alias("avg_efficiency_rate"),
        _sum("profit_loss").alias("total_profit_loss"),
        F.count(F.lit(1)).alias("working_days"),
        _sum("billable_hours").alias("total_billable_hours"),
        _sum("remote_sessions", "bigint").alias("total_remote_sessions"),
        _sum("vehicle_usage", "bigint").alias("vehicle_days"),
        F.coalesce(N.exact_avg(F.col("onsite_hours")), zero).alias("avg_onsite_hours"),
        F.coalesce(N.exact_avg(F.col("travel_hours")), zero).alias("avg_travel_hours"),
    )
    both = (F.col("total_remote_sessions") > 0) & (F.col("avg_onsite_hours") > 0)
    ratio = N.half_up(N.ratio(F.col("total_remote_sessions"), F.col("avg_onsite_hours")))
    return out.withColumn("remote_vs_onsite_ratio", F.when(both, ratio).otherwise(zero))


def rounded_summary(summary: DataFrame, digits: int = 2) -> DataFrame:
    """The summary as it is published: money, hours and means to two digits."""

    def signed(c: Column) -> Column:
        return F.when(c < 0, -N.half_up(-c, digits)).otherwise(N.half_up(c, digits))

    doubles = [
        "avg_efficiency_rate", "total_profit_loss", "total_billable_hours", "avg_onsite_hours",
        "avg_travel_hours", "remote_vs_onsite_ratio",
    ]
    return summary.select(
        *[
            signed(F.col(c).cast("double")).alias(c) if c in doubles else F.col(c)
            for c in summary.columns
        ]
    )


def client_profitability(
    clients: DataFrame,
    timesheets: DataFrame,
    kpi: DataFrame,
    date_from=None,
    date_to=None,
    faithful: bool = False,
) -> DataFrame:
    """KPI totals of the days worked at each client.

    Timesheets shrink to one row per (client, employee, day) before the join, so the join
    input no longer depends on the number of punches.  By default a KPI row counts once
    per client and day; ``faithful`` counts it once per punch, as a row-level join does.
    Employees are counted by a second aggregation level instead of a distinct count.
    """
    visits = (
        timesheets.where(F.col("client_id").isNotNull())
        .where(within("work_date", date_from, date_to))
        .groupBy("client_id", *KEYS)
        .agg(F.count(F.lit(1)).alias("punches"))
    )
    weight = F.col("punches") if faithful else F.lit(1)
    k = filtered(kpi, None, date_from, date_to)
    per_employee = (
        visits.join(k, KEYS)
        .groupBy("client_id", "employee_id")
        .agg(
            *[
                F.sum(F.col(c) * weight).alias(c)
                for c in ("billable_hours", "revenue", "daily_cost", "profit_loss", "efficiency_rate")
            ],
            F.sum(weight).alias("rows"),
        )
    )
    totals = per_employee.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("employees"),
        F.sum("billable_hours").alias("billable_hours"),
        F.sum("revenue").alias("revenue"),
        F.sum("daily_cost").alias("cost"),
        F.sum("profit_loss").alias("profit_loss"),
        N.ratio(F.sum("efficiency_rate"), F.sum("rows")).alias("avg_efficiency_rate"),
    )
    return (
        clients.select("client_id", "client_name")
        .join(totals, "client_id")
        .orderBy(F.desc("profit_loss"), "client_id")
    )


def vehicle_efficiency(
    vehicles: DataFrame, vehicle_log: DataFrame, date_from=None, date_to=None, faithful: bool = False
) -> DataFrame:
    """Uses, users, mean hours and distance cost per vehicle.

    Unused vehicles show with zeros.  With a period, ``faithful`` drops them: the period
    condition sits behind the outer join there.  The mean counts an open return as 0 hours.
    The log is aggregated before it meets the vehicle table.
    """
    hours = N.to_micro(
        T.minutes_between(F.col("pickup_ts"), F.col("return_ts")).cast("double") / F.lit(60.0)
    )
    per_employee = (
        vehicle_log.where(within("work_date", date_from, date_to))
        .groupBy("vehicle_id", "employee_id")
        .agg(
            F.count(F.lit(1)).alias("uses"),
            F.coalesce(F.sum(hours), F.lit(0)).alias("micro"),
            F.coalesce(F.sum(F.col("km").cast("bigint")), F.lit(0)).alias("km"),
        )
    )
    totals = per_employee.groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("uses").alias("uses"),
        F.sum("micro").alias("micro"),
        F.sum("km").alias("km"),
    )
    bounded = date_from is not None or date_to is not None
    how = "inner" if faithful and bounded else "left"
    zero = F.lit(0)
    mean = N.ratio(F.col("micro"), F.col("uses") * F.lit(N.MICRO))
    return (
        vehicles.join(totals, "vehicle_id", how)
        .select(
            "vehicle_id",
            "vehicle_name",
            F.coalesce("users", zero).alias("users"),
            F.coalesce("uses", zero).alias("uses"),
            F.coalesce(mean, F.lit(0.0)).alias("avg_hours"),
            (F.coalesce("km", zero) * F.col("cost_km")).cast("decimal(18,2)").alias("estimated_cost"),
        )
        .orderBy(F.desc("uses"), "vehicle_id")
    )


def monthly_trends(kpi: DataFrame, as_of, months: int = 6) -> DataFrame:
    """Totals and means per month over the last ``months`` months before ``as_of``."""
    since = F.add_months(as_date(as_of), -months)
    k = kpi.where(F.col("work_date") >= since)
    on_site = N.ratio(F.col("onsite_hours"), F.col("onsite_hours") + F.col("travel_hours"))
    share = N.to_micro(on_site * F.lit(100.0))
    per_employee = k.groupBy(
        F.year("work_date").alias("year"), F.month("work_date").alias("month"), "employee_id"
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("efficiency_rate").alias("efficiency"),
        F.sum("profit_loss").alias("profit_loss"),
        F.sum("billable_hours").alias("billable_hours"),
        F.sum("remote_sessions").alias("remote_sessions"),
        F.sum(share).alias("share"),
        F.count(share).alias("share_rows"),
    )
    return (
        per_employee.groupBy("year", "month")
        .agg(
            F.count(F.lit(1)).alias("active_employees"),
            N.ratio(F.sum("efficiency"), F.sum("rows")).alias("avg_efficiency_rate"),
            F.sum("profit_loss").alias("profit_loss"),
            F.sum("billable_hours").alias("billable_hours"),
            F.sum("remote_sessions").alias("remote_sessions"),
            N.ratio(F.sum("share"), F.sum("share_rows") * F.lit(N.MICRO)).alias("onsite_percentage"),
        )
        .orderBy(F.desc("year"), F.desc("month"))
    )


def top_performers(
    employees: DataFrame, kpi: DataFrame, date_from=None, date_to=None, limit: int = 10
) -> DataFrame:
    """Employees by profit, then mean efficiency; the limit is clamped to 1..100.

    KPI rows are aggregated and cut to the top before names are attached.
    """
    limit = max(1, min(100, int(limit)))
    order = [F.desc("profit_loss"), F.desc("avg_efficiency_rate"), F.col("employee_id")]
    totals = (
        filtered(kpi, None, date_from, date_to)
        .groupBy("employee_id")
        .agg(
            N.exact_avg(F.col("efficiency_rate")).alias("avg_efficiency_rate"),
            F.sum("profit_loss").alias("profit_loss"),
            F.sum("billable_hours").alias("billable_hours"),
            F.count(F.lit(1)).alias("working_days"),
            F.sum("remote_sessions").alias("remote_sessions"),
        )
        .orderBy(*order)
        .limit(limit)
    )
    names = employees.select("employee_id", "full_name")
    return totals.join(names, "employee_id").orderBy(*order)


def alert_counts(
    kpi: DataFrame, date_from=None, date_to=None, settings: Settings | None = None
) -> DataFrame:
    """Four threshold counters and their total."""
    s = settings or Settings()
    rate = F.col("efficiency_rate")
    counts = filtered(kpi, None, date_from, date_to).agg(
        count_where(rate < F.lit(s.efficiency_warning)).alias("efficiency_warnings"),
        count_where(rate < F.lit(s.efficiency_critical)).alias("efficiency_critical"),
        count_where(F.col("profit_loss") < F.lit(s.profit_warning)).alias("profit_warnings"),
        count_where(F.col("billable_hours") < F.lit(s.min_hours)).alias("insufficient_hours"),
    )
    total = sum((F.col(c) for c in counts.columns), F.lit(0))
    return counts.withColumn("total", total)


def performance_series(
    kpi: DataFrame, as_of, period: int = 7, employee_id=None
) -> DataFrame:
    """One row per day of the last ``period`` days up to ``as_of``; days without KPI rows
    show zeros."""
    last = as_date(as_of)
    first = F.date_sub(last, period)
    daily = (
        filtered(kpi, employee_id, first, last)
        .groupBy("work_date")
        .agg(
            N.exact_avg(F.col("efficiency_rate")).alias("e"),
            F.sum("profit_loss").alias("p"),
            F.sum("billable_hours").alias("b"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    zero = F.lit(0).cast("decimal(18,2)")
    return (
        days(kpi.sparkSession, first, last)
        .join(daily, "work_date", "left")
        .select(
            "work_date",
            F.date_format("work_date", "dd/MM").alias("label"),
            F.coalesce("e", F.lit(0.0)).alias("efficiency_rate"),
            F.coalesce("p", zero).alias("profit_loss"),
            F.coalesce("b", zero).alias("billable_hours"),
            F.coalesce("n", F.lit(0)).alias("active_employees"),
        )
        .orderBy("work_date")
    )


def daily_performance(
    employees: DataFrame,
    kpi: DataFrame,
    absences: DataFrame,
    anomalies: DataFrame,
    settings: Settings | None = None,
    faithful: bool = False,
) -> DataFrame:
    """KPI rows of active employees with a status flag and the number of open anomalies.

    Absences and anomalies are reduced per (employee, day) first, so the three inputs meet
    one to one.  ``faithful`` multiplies the anomaly count by the number of absences that
    cover the day and keeps active employees without KPI rows, as the row-level view does.
    """
    s = settings or Settings()
    away = absence_days(absences)
    opened = (
        anomalies.where(~F.col("resolved")).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("open"))
    )
    people = employees.where("active").select("employee_id", "full_name")
    rows = (
        kpi.select(
            *KEYS, "timesheet_hours", "billable_hours", "efficiency_rate", "profit_loss",
            "daily_cost", "revenue",
        )
        .join(away, KEYS, "left")
        .join(opened, KEYS, "left")
    )
    joined = people.join(rows, "employee_id", "left" if faithful else "inner")
    status = (
        F.when((F.col("billable_hours") < F.lit(s.min_hours)) & F.col("absences").isNull(), "ALERT")
        .when(F.col("efficiency_rate") < F.lit(s.efficiency_warning), "WARNING")
        .otherwise("OK")
    )
    times = F.greatest(F.coalesce("absences", F.lit(1)), F.lit(1)) if faithful else F.lit(1)
    return joined.select(
        "employee_id", "full_name", "work_date", "timesheet_hours", "billable_hours",
        "efficiency_rate", "profit_loss", "daily_cost", "revenue",
        status.alias("status"),
        (F.coalesce("open", F.lit(0)) * times).alias("anomaly_count"),
    )


def _gap_columns() -> tuple[Column, Column]:
    ts = F.col("timesheet_hours")
    return F.abs(ts - F.col("activity_hours")), F.abs(ts - F.col("calendar_hours"))


def correlation_score() -> Column:
    act, cal = _gap_columns()
    return (
        F.when((act <= 1) & (cal <= 1), 100)
        .when((act <= 2) | (cal <= 2), 75)
        .when((act <= 3) | (cal <= 3), 50)
        .otherwise(25)
    )


def correlation_metrics(kpi: DataFrame) -> DataFrame:
    """Gaps between the three hour sources and a score, for days with punches."""
    act, cal = _gap_columns()
    return kpi.where("timesheet_hours > 0").select(
        *KEYS,
        "timesheet_hours",
        "activity_hours",
        "calendar_hours",
        act.alias("activity_gap"),
        cal.alias("calendar_gap"),
        correlation_score().alias("correlation_score"),
    )


def correlation_by_employee(kpi: DataFrame, employee_id=None, date_from=None, date_to=None) -> DataFrame:
    """Mean score per employee, two digits."""
    k = filtered(kpi, employee_id, date_from, date_to).where("timesheet_hours > 0")
    return k.groupBy("employee_id").agg(
        N.half_up(N.exact_avg(correlation_score())).alias("correlation_score")
    )


def health_scores(
    employees: DataFrame,
    kpi: DataFrame,
    anomalies: DataFrame,
    employee_id=None,
    date_from=None,
    date_to=None,
) -> DataFrame:
    """100, less 5 per open anomaly, less what the correlation score lacks, within 0..100."""
    scores = correlation_by_employee(kpi, employee_id, date_from, date_to)
    opened = (
        filtered(anomalies.where(~F.col("resolved")), employee_id, date_from, date_to)
        .groupBy("employee_id")
        .agg(F.count(F.lit(1)).alias("open_anomalies"))
    )
    people = employees.select("employee_id")
    if employee_id is not None:
        people = people.where(F.col("employee_id") == employee_id)
    score = F.coalesce("correlation_score", F.lit(0.0))
    opens = F.coalesce("open_anomalies", F.lit(0))
    raw = F.lit(100.0) - opens * F.lit(5.0) - (F.lit(100.0) - score)
    return (
        people.join(scores, "employee_id", "left")
        .join(opened, "employee_id", "left")
        .select(
            "employee_id",
            opens.alias("open_anomalies"),
            score.alias("correlation_score"),
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)).alias("health_score"),
        )
    )


def anomaly_stats(anomalies: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Total and unresolved anomalies per type and severity, most severe first."""
    return (
        filtered(anomalies, None, date_from, date_to)
        .groupBy("type", "severity")
        .agg(F.count(F.lit(1)).alias("total"), count_where(~F.col("resolved")).alias("unresolved"))
        .orderBy(F.desc(severity_rank(F.col("severity"))), "type")
    )


def calculation_progress(timesheets: DataFrame, employees: DataFrame, kpi: DataFrame) -> DataFrame:
    """KPI rows present against days times active employees."""
    span = timesheets.agg(
        (F.datediff(F.max("work_date"), F.min("work_date")) + 1).cast("bigint").alias("n")
    ).scalar()
    active = employees.where("active").agg(F.count(F.lit(1))).scalar()
    rows = kpi.agg(F.count(F.lit(1)).alias("current_rows"))
    return rows.select(
        "current_rows", span.alias("total_days"), active.alias("active_employees")
    ).select(
        "*",
        (F.col("total_days") * F.col("active_employees")).alias("expected_rows"),
        F.coalesce(
            N.half_up(
                N.ratio(F.col("current_rows"), F.col("total_days") * F.col("active_employees"))
                * F.lit(100.0),
                1,
            ),
            F.lit(0.0),
        ).alias("progress"),
    )
