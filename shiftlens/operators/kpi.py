"""The daily KPI job: one row per active employee and day.

Plan.  Every feed is projected to rows of measures keyed by (employee, day); the spine is
one more such input.  All rows are united and aggregated once, so the whole job needs a
single exchange on (employee, day), and the map-side part of the aggregation collapses a
hot employee before that exchange.  Nothing is joined except the client check of the
on-site hours.

``*_rows`` functions project, the functions without the suffix aggregate one feed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.functions import numeric as N, temporal as T
from shiftlens.operators.common import as_date, meets, starts_within, union_all, within
from shiftlens.operators.spine import employee_days, period_bounds
from shiftlens.settings import Settings

KEYS = ["employee_id", "work_date"]
MEASURES = [
    "timesheet_micro",
    "activity_micro",
    "calendar_micro",
    "billable_micro",
    "onsite_micro",
    "travel_micro",
    "remote_sessions",
    "vehicle_uses",
]


# ---------------------------------------------------------------- measure rows


def _decimal_micro(hours: Column) -> Column:
    """A decimal number of hours -> whole millionths, exactly."""
    return (hours.cast("decimal(18,6)") * F.lit(N.MICRO)).cast("bigint")


def _per_day(rows: DataFrame) -> DataFrame:
    measures = [c for c in rows.columns if c not in KEYS]
    return rows.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in measures])


def timesheet_rows(timesheets: DataFrame, *keep: str) -> DataFrame:
    return timesheets.select(*KEYS, *keep, _decimal_micro(F.col("hours")).alias("timesheet_micro"))


def timesheet_hours(timesheets: DataFrame) -> DataFrame:
    """Hours punched per employee and day."""
    return _per_day(timesheet_rows(timesheets))


def onsite_rows(timesheets: DataFrame, clients: DataFrame, *keep: str) -> DataFrame:
    """Punches at a client that exists.  Rows without a client are dropped before the join,
    so the missing key never forms a hot partition."""
    at_client = timesheets.where(F.col("client_id").isNotNull())
    known = clients.select("client_id")
    return at_client.join(known, "client_id", "left_semi").select(
        *KEYS, *keep, _decimal_micro(F.col("hours")).alias("onsite_micro")
    )


def onsite_hours(timesheets: DataFrame, clients: DataFrame) -> DataFrame:
    """Hours punched at a known client per employee and day."""
    return _per_day(onsite_rows(timesheets, clients))


def spread_over_days(df: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """A span row becomes one row per day it touches, with ``day_minutes`` and
    ``single_day``; the other columns are repeated."""
    start, end = F.col("start_ts"), F.col("end_ts")
    out = T.explode_days(
        df, F.to_date(start), F.to_date(end), "work_date", as_date(date_from), as_date(date_to)
    )
    return out.select(
        "*",
        T.is_single_day(start, end).alias("single_day"),
        T.minutes_on_day(start, end, F.col("work_date")).alias("day_minutes"),
    )


def _share_of_duration() -> Column:
    """Recorded duration, shared over the days of a span by their minutes; NULL for a span
    of several days with no whole minute at all."""
    total = T.minutes_between(F.col("start_ts"), F.col("end_ts"))
    shared = F.try_divide(
        F.col("day_minutes").cast("double") * F.col("duration_hours").cast("double"),
        total.cast("double"),
    )
    return F.when(F.col("single_day"), _decimal_micro(F.col("duration_hours"))).otherwise(
        N.to_micro(shared)
    )


def _wall_clock() -> Column:
    return N.to_micro(F.col("day_minutes").cast("double") / F.lit(60.0))


def activity_rows(activities: DataFrame, date_from=None, date_to=None, keep: tuple = ()) -> DataFrame:
    """Activity and billable hours, one row per activity and day it touches.

    Activity hours: the recorded duration on a single day, wall-clock time per day
    otherwise.  Billable hours: the recorded duration, shared over the days."""
    worked = F.when(F.col("single_day"), _decimal_micro(F.col("duration_hours"))).otherwise(
        _wall_clock()
    )
    return spread_over_days(activities, date_from, date_to).select(
        *KEYS,
        *keep,
        worked.alias("activity_micro"),
        F.when(F.col("billable"), _share_of_duration()).alias("billable_micro"),
    )


def activity_hours(activities: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Activity and billable hours per employee and day."""
    return _per_day(activity_rows(activities, date_from, date_to))


def calendar_rows(calendar: DataFrame, date_from=None, date_to=None, keep: tuple = ()) -> DataFrame:
    return spread_over_days(calendar, date_from, date_to).select(
        *KEYS, *keep, _wall_clock().alias("calendar_micro")
    )


def calendar_hours(calendar: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Hours of appointments per employee and day."""
    return _per_day(calendar_rows(calendar, date_from, date_to))


def remote_rows(remote_sessions: DataFrame, *keep: str) -> DataFrame:
    return remote_sessions.select(
        "employee_id", F.to_date("start_ts").alias("work_date"), *keep, F.lit(1).alias("remote_sessions")
    )


def remote_session_count(remote_sessions: DataFrame) -> DataFrame:
    """Remote sessions started per employee and day."""
    return _per_day(remote_rows(remote_sessions))


def vehicle_rows(vehicle_log: DataFrame, *keep: str) -> DataFrame:
    minutes = T.minutes_between(F.col("pickup_ts"), F.col("return_ts")).cast("double")
    return vehicle_log.select(
        *KEYS,
        *keep,
        F.coalesce(N.to_micro(minutes / F.lit(60.0)), F.lit(0)).alias("travel_micro"),
        F.lit(1).alias("vehicle_uses"),
    )


def vehicle_measures(vehicle_log: DataFrame) -> DataFrame:
    """Hours driven (returned vehicles only) and number of uses per employee and day."""
    return _per_day(vehicle_rows(vehicle_log))


# ---------------------------------------------------------------- derived measures

# Effective hours are the larger of the two sources: none is negative, so one missing
# source simply is 0.
EFFECTIVE = "greatest(timesheet_micro, activity_micro)"


def efficiency_sql(s: Settings) -> str:
    """Billable share of the effective hours in percent, capped."""
    idle = float(s.hours_per_day) * N.MICRO
    base = f"case when {EFFECTIVE} > 0 then cast({EFFECTIVE} as double) else {idle}D end"
    return f"least({float(s.efficiency_cap)}D, cast(billable_micro as double) / ({base}) * 100D)"


def _alert_rules() -> list[tuple[str, str, str, str]]:
    """(level, code, condition, message), as SQL over the measures of a KPI row."""
    ts, act = N.micro_sql("timesheet_micro"), N.micro_sql("activity_micro")
    cal, bill = N.micro_sql("calendar_micro"), N.micro_sql("billable_micro")
    gap = (
        "try_divide(cast(abs(activity_micro - timesheet_micro) as double), "
        "cast(timesheet_micro as double)) * 100D"
    )
    gap_text = N.micro_sql(f"floor({gap} * 1000000D + 0.5D)")
    rate_text = N.micro_sql("floor(raw_efficiency * 1000000D + 0.5D)")
    return [
        (
            "CRITICAL",
            "billable_exceeds_timesheet",
            "timesheet_micro > 0 and billable_micro > timesheet_micro",
            f"concat('billable ', {bill}, 'h over timesheet ', {ts}, 'h')",
        ),
        (
            "WARNING",
            "timesheet_activity_mismatch",
            f"timesheet_micro > 0 and activity_micro > 0 and {gap} > 25D",
            f"concat('gap ', {gap_text}, '% between timesheet ', {ts}, 'h and activities ', {act}, 'h')",
        ),
        (
            "WARNING",
            "missing_timesheet",
            "calendar_micro > 0 and timesheet_micro = 0",
            f"concat('calendar ', {cal}, 'h without timesheet')",
        ),
        (
            "INFO",
            "high_efficiency",
            "raw_efficiency > 120D",
            f"concat('efficiency ', {rate_text}, '%')",
        ),
        (
            "WARNING",
            "billable_without_timesheet",
            "billable_micro > 0 and timesheet_micro = 0",
            f"concat('billable ', {bill}, 'h without timesheet')",
        ),
    ]


def alerts_sql() -> str:
    """Array of the alerts a KPI row raises, at most one per rule."""
    rules = ", ".join(
        f"case when {condition} then named_struct('level', '{level}', 'code', '{code}', 'message', {message}) end"
        for level, code, condition, message in _alert_rules()
    )
    return f"filter(array({rules}), a -> a is not null)"


# Severity of an alert level when it becomes an anomaly.
ALERT_SEVERITY = {"CRITICAL": "critical", "WARNING": "high", "INFO": "medium"}


# ---------------------------------------------------------------- assembly


def daily_measures(
    employees: DataFrame,
    timesheets: DataFrame,
    activities: DataFrame,
    calendar: DataFrame,
    remote_sessions: DataFrame,
    vehicle_log: DataFrame,
    clients: DataFrame,
    date_from,
    date_to,
) -> DataFrame:
    """Spine plus all measures, one exchange."""
    spine = employee_days(employees, date_from, date_to).select(
        *KEYS, F.col("daily_cost").alias("own_cost"), F.lit(1).alias("on_spine")
    )
    in_period = within("work_date", date_from, date_to)
    started = starts_within("start_ts", date_from, date_to)
    touching = meets("start_ts", "end_ts", date_from, date_to)
    parts = [
        spine,
        timesheet_rows(timesheets.where(in_period)),
        onsite_rows(timesheets.where(in_period), clients),
        activity_rows(activities.where(touching), date_from, date_to),
        calendar_rows(calendar.where(touching), date_from, date_to),
        remote_rows(remote_sessions.where(started)),
        vehicle_rows(vehicle_log.where(in_period)),
    ]
    return summed(parts)


def summed(parts: list[DataFrame]) -> DataFrame:
    """Spine rows (own_cost, on_spine) and measure rows -> one row per key of the spine."""
    return (
        union_all(parts, fill=True)
        .groupBy(*KEYS)
        .agg(
            F.max("on_spine").alias("on_spine"),
            F.max("own_cost").alias("own_cost"),
            *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES],
        )
        .where("on_spine = 1")
        .drop("on_spine")
    )


def daily_kpi(
    employees: DataFrame,
    timesheets: DataFrame,
    activities: DataFrame,
    calendar: DataFrame,
    remote_sessions: DataFrame,
    vehicle_log: DataFrame,
    clients: DataFrame,
    date_from=None,
    date_to=None,
    settings: Settings | None = None,
    as_of=None,
) -> DataFrame:
    """KPI rows of a period; without bounds, of the whole span of the timesheets, none of which
    may be dated after ``as_of``."""
    s = settings or Settings()
    if date_from is None or date_to is None:
        lo, hi = period_bounds(timesheets, as_of)
        date_from = lo if date_from is None else date_from
        date_to = hi if date_to is None else date_to
    m = daily_measures(
        employees, timesheets, activities, calendar, remote_sessions, vehicle_log, clients,
        date_from, date_to,
    )
    return kpi_rows(m, s)


def kpi_rows(measures: DataFrame, s: Settings) -> DataFrame:
    """KPI rows of summed measures."""
    revenue = f"{N.micro_sql('billable_micro', 6)} * cast({s.hourly_rate} as decimal(8,2))"
    cost = f"cast(coalesce(own_cost, {s.default_daily_cost}) as decimal(18,2))"
    rated = measures.selectExpr("*", f"{efficiency_sql(s)} as raw_efficiency", f"{cost} as daily_cost")
    return rated.selectExpr(
        *KEYS,
        f"{N.micro_sql('timesheet_micro')} as timesheet_hours",
        f"{N.micro_sql('activity_micro')} as activity_hours",
        f"{N.micro_sql('calendar_micro')} as calendar_hours",
        f"{N.micro_sql('billable_micro')} as billable_hours",
        f"{N.micro_sql('floor(raw_efficiency * 1000000D + 0.5D)')} as efficiency_rate",
        "daily_cost",
        f"cast({revenue} as decimal(18,2)) as revenue",
        f"cast({revenue} - daily_cost as decimal(18,2)) as profit_loss",
        "remote_sessions",
        f"{N.micro_sql('onsite_micro')} as onsite_hours",
        f"{N.micro_sql('travel_micro')} as travel_hours",
        "cast(vehicle_uses > 0 as int) as vehicle_usage",
        f"{alerts_sql()} as alerts",
    )


def alert_anomalies(kpi: DataFrame) -> DataFrame:
    """The alerts of KPI rows as anomaly rows."""
    a = F.col("alert")
    severity = F.coalesce(
        F.try_element_at(
            F.create_map(*[F.lit(x) for kv in ALERT_SEVERITY.items() for x in kv]), a.level
        ),
        F.lit("medium"),
    )
    return kpi.select(*KEYS, F.explode("alerts").alias("alert")).select(
        *KEYS,
        a.code.alias("type"),
        severity.alias("severity"),
        a.message.alias("description"),
        F.lit(None).cast("string").alias("details"),
    )
