"""Queries over the daily KPI job and its single measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shiftlens.operators import kpi as K, spine as S
from shiftlens.plans.domain import Domain
from shiftlens.plans.registry import Query

KPI_COLUMNS = (
    "employee_id work_date:text timesheet_hours:num activity_hours:num calendar_hours:num "
    "billable_hours:num efficiency_rate:num daily_cost:num revenue:num profit_loss:num "
    "remote_sessions onsite_hours:num travel_hours:num vehicle_usage"
)


def kpi_of(d: Domain) -> DataFrame:
    return K.daily_kpi(
        d.employees, d.timesheets, d.activities, d.calendar, d.remote_sessions, d.vehicle_log,
        d.clients,
    )


def _spine(d: Domain) -> DataFrame:
    lo, hi = S.period_bounds(d.timesheets)
    return S.employee_days(d.employees, lo, hi)


def _micro(name: str) -> str:
    return f"({name}::decimal(20,0) * 0.000001)::decimal(18,6) as {name}"


ALERTS_SQL = """
    select employee_id, work_date, code, level, message from (
      select employee_id, work_date,
             (ts * 0.000001)::decimal(18,2)::varchar as ts_h, (act * 0.000001)::decimal(18,2)::varchar as act_h,
             (cal * 0.000001)::decimal(18,2)::varchar as cal_h, (bill * 0.000001)::decimal(18,2)::varchar as bill_h,
             (floor(raw_eff * 1000000.0::double + 0.5::double)::decimal(20,0) * 0.000001)::decimal(18,2)::varchar as eff,
             (floor(gap * 1000000.0::double + 0.5::double)::decimal(20,0) * 0.000001)::decimal(18,2)::varchar as gap_t, *
      from (select *, abs(act - ts)::double / nullif(ts, 0)::double * 100.0::double as gap from (
              select employee_id, work_date, ts::decimal(20,0) as ts, act::decimal(20,0) as act,
                     cal::decimal(20,0) as cal, bill::decimal(20,0) as bill, raw_eff from measures)))
    cross join lateral (values
      ('billable_exceeds_timesheet', 'CRITICAL', ts > 0 and bill > ts,
       'billable ' || bill_h || 'h over timesheet ' || ts_h || 'h'),
      ('timesheet_activity_mismatch', 'WARNING', ts > 0 and act > 0 and gap > 25,
       'gap ' || gap_t || '% between timesheet ' || ts_h || 'h and activities ' || act_h || 'h'),
      ('missing_timesheet', 'WARNING', cal > 0 and ts = 0, 'calendar ' || cal_h || 'h without timesheet'),
      ('high_efficiency', 'INFO', raw_eff > 120, 'efficiency ' || eff || '%'),
      ('billable_without_timesheet', 'WARNING', bill > 0 and ts = 0, 'billable ' || bill_h || 'h without timesheet')
    ) as r(code, level, fires, message)
    where fires"""


def _alerts(d: Domain) -> DataFrame:
    a = F.col("alert")
    return (
        kpi_of(d)
        .select("employee_id", "work_date", F.explode("alerts").alias("alert"))
        .select("employee_id", "work_date", a.code.alias("code"), a.level.alias("level"),
                a.message.alias("message"))
    )


QUERIES = {
    "daily_kpi": Query(KPI_COLUMNS, kpi_of, "select * from kpi", ["kpi"]),
    "employee_day_spine": Query(
        "employee_id work_date:text", _spine, "select employee_id, work_date from spine", ["spine"]
    ),
    "timesheet_hours": Query(
        "employee_id work_date:text timesheet_micro",
        lambda d: K.timesheet_hours(d.timesheets),
        "select employee_id, work_date, ts as timesheet_micro from k_ts",
        ["k_ts"],
    ),
    "activity_and_billable_hours": Query(
        "employee_id work_date:text activity_micro billable_micro",
        lambda d: K.activity_hours(d.activities),
        "select employee_id, work_date, act as activity_micro, bill as billable_micro from k_act",
        ["k_act"],
    ),
    "calendar_hours": Query(
        "employee_id work_date:text calendar_micro",
        lambda d: K.calendar_hours(d.calendar),
        "select employee_id, work_date, cal as calendar_micro from k_cal",
        ["k_cal"],
    ),
    "remote_session_count": Query(
        "employee_id work_date:text remote_sessions",
        lambda d: K.remote_session_count(d.remote_sessions),
        "select * from k_rem",
        ["k_rem"],
    ),
    "onsite_hours": Query(
        "employee_id work_date:text onsite_micro",
        lambda d: K.onsite_hours(d.timesheets, d.clients),
        "select employee_id, work_date, onsite as onsite_micro from k_on",
        ["k_on"],
    ),
    "travel_hours_and_vehicle_use": Query(
        "employee_id work_date:text travel_micro vehicle_uses",
        lambda d: K.vehicle_measures(d.vehicle_log),
        "select employee_id, work_date, travel as travel_micro, uses as vehicle_uses from k_veh",
        ["k_veh"],
    ),
    "kpi_alerts": Query(
        "employee_id work_date:text code:text level:text message:text",
        _alerts,
        ALERTS_SQL,
        ["measures"],
    ),
    "kpi_alert_anomalies": Query(
        "employee_id work_date:text type:text severity:text description:text",
        lambda d: K.alert_anomalies(kpi_of(d)),
        f"""select employee_id, work_date, code as type,
                   case level when 'CRITICAL' then 'critical' when 'WARNING' then 'high' else 'medium' end as severity,
                   message as description
            from ({ALERTS_SQL})""",
        ["measures"],
    ),
}
