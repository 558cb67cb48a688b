"""Queries over the reports."""

from __future__ import annotations

from shiftlens.operators import reports as R, rollups as RU
from shiftlens.operators.common import active_only
from shiftlens.plans.kpi_queries import kpi_of
from shiftlens.plans.registry import Query
from shiftlens.plans.validation_queries import anomalies_of

AS_OF = "2024-01-31"

SUMMARY_SQL = """
    select coalesce(sum(efficiency_rate)::double / count(*)::double, 0) as avg_efficiency_rate,
           coalesce(sum(profit_loss), 0) as total_profit_loss, count(*) as working_days,
           coalesce(sum(billable_hours), 0) as total_billable_hours,
           coalesce(sum(remote_sessions), 0) as total_remote_sessions,
           coalesce(sum(vehicle_usage), 0) as vehicle_days,
           coalesce(sum(onsite_hours)::double / count(*)::double, 0) as avg_onsite_hours,
           coalesce(sum(travel_hours)::double / count(*)::double, 0) as avg_travel_hours,
           case when sum(remote_sessions) > 0 and sum(onsite_hours) > 0 then
             floor(sum(remote_sessions)::double / (sum(onsite_hours)::double / count(*)::double)
                   * 100.0::double + 0.5::double) / 100.0::double else 0 end as remote_vs_onsite_ratio
    from kpi"""


def _signed(c: str) -> str:
    return (
        f"case when {c} < 0 then -(floor(-({c}::double) * 100.0::double + 0.5::double) / 100.0::double) "
        f"else floor({c}::double * 100.0::double + 0.5::double) / 100.0::double end as {c}"
    )


CLIENT_COLUMNS = (
    "client_id client_name:text employees billable_hours:num revenue:num cost:num "
    "profit_loss:num avg_efficiency_rate:num"
)
CLIENT_SQL = """
    select c.client_id, c.client_name, count(distinct k.employee_id) as employees,
           sum(k.billable_hours) as billable_hours, sum(k.revenue) as revenue, sum(k.daily_cost) as cost,
           sum(k.profit_loss) as profit_loss,
           sum(k.efficiency_rate)::double / count(*)::double as avg_efficiency_rate
    from clients c join {visits} t using (client_id)
    join kpi k on k.employee_id = t.employee_id and k.work_date = t.work_date
    group by all"""

PERFORMANCE_COLUMNS = (
    "employee_id full_name:text work_date:text timesheet_hours:num billable_hours:num "
    "efficiency_rate:num profit_loss:num daily_cost:num revenue:num status:text anomaly_count"
)
SUMMARY_COLUMNS = (
    "avg_efficiency_rate:num total_profit_loss:num working_days total_billable_hours:num "
    "total_remote_sessions vehicle_days avg_onsite_hours:num avg_travel_hours:num remote_vs_onsite_ratio:num"
)

SCORE = """case when abs(timesheet_hours - activity_hours) <= 1 and abs(timesheet_hours - calendar_hours) <= 1 then 100
     when abs(timesheet_hours - activity_hours) <= 2 or abs(timesheet_hours - calendar_hours) <= 2 then 75
     when abs(timesheet_hours - activity_hours) <= 3 or abs(timesheet_hours - calendar_hours) <= 3 then 50
     else 25 end"""
CORRELATION_SQL = f"""
    select employee_id, floor(sum({SCORE})::double / count(*)::double * 100.0::double + 0.5::double) / 100.0::double as correlation_score
    from kpi where timesheet_hours > 0 group by employee_id"""

VEHICLE_SQL = """
    select v.vehicle_id, v.vehicle_name, count(distinct l.employee_id) as users, count(l.id) as uses,
           coalesce(sum(coalesce(floor(date_sub('minute', pickup_ts, return_ts)::double / 60.0::double * 1000000.0::double + 0.5::double)::bigint, 0))::double
                    / nullif(count(l.id) * 1000000, 0)::double, 0) as avg_hours,
           coalesce(sum(km), 0) * any_value(cost_km) as estimated_cost
    from vehicles v left join {log} l using (vehicle_id) group by v.vehicle_id, v.vehicle_name"""

def _members(d):
    return RU.daily_bitmaps(d.timesheets, "client_id", "employee_id")


QUERIES = {
    "distinct_users_per_window": Query(
        "client_id work_date:text members_7 members_30",
        lambda d: RU.distinct_in_windows(_members(d), "client_id", [7, 30]),
        """with visits as (select distinct client_id, work_date, employee_id from timesheets where client_id is not null),
             days as (select client_id, unnest(generate_series(min(work_date), (select max(work_date) from visits), interval 1 day))::date as work_date
                      from visits group by client_id)
           select d.client_id, d.work_date,
               count(distinct case when v.work_date > d.work_date - 7 then v.employee_id end) as members_7,
               count(distinct v.employee_id) as members_30
           from days d left join visits v on v.client_id = d.client_id and v.work_date between d.work_date - 29 and d.work_date
           group by all""",
        ["timesheets"],
    ),
    "distinct_users_in_period": Query(
        "client_id members",
        lambda d: RU.distinct_in_period(_members(d), "client_id", "2024-01-10", "2024-01-20"),
        """select client_id, count(distinct employee_id) as members from timesheets
           where client_id is not null and work_date between date '2024-01-10' and date '2024-01-20' group by client_id""",
        ["timesheets"],
    ),
    "kpi_rollup": Query(
        "grain:text employee_id month:text work_date:text days timesheet_hours:num billable_hours:num revenue:num daily_cost:num "
        "profit_loss:num remote_sessions vehicle_usage least_efficiency:num best_efficiency:num",
        lambda d: RU.kpi_rollup(kpi_of(d)),
        """select case when grouping(work_date) = 0 then 'work_date' when grouping(employee_id) = 0 and grouping(month) = 0 then 'employee_id_month'
                   when grouping(employee_id) = 0 then 'employee_id' when grouping(month) = 0 then 'month' else 'all' end as grain,
               employee_id, month, work_date, count(*) as days, sum(timesheet_hours) as timesheet_hours, sum(billable_hours) as billable_hours,
               sum(revenue) as revenue, sum(daily_cost) as daily_cost, sum(profit_loss) as profit_loss, sum(remote_sessions) as remote_sessions,
               sum(vehicle_usage) as vehicle_usage, min(efficiency_rate) as least_efficiency, max(efficiency_rate) as best_efficiency
           from (select *, date_trunc('month', work_date)::date as month from kpi)
           group by grouping sets ((work_date), (month), (employee_id), (employee_id, month), ())""",
        ["kpi"],
    ),
    "active_employees": Query(
        "employee_id first_name:text last_name:text",
        lambda d: active_only(d.employees).orderBy("last_name", "first_name", "employee_id"),
        "select employee_id, first_name, last_name from employees where active",
        ["employees"],
    ),
    "kpi_summary": Query(SUMMARY_COLUMNS, lambda d: R.kpi_summary(kpi_of(d)), SUMMARY_SQL, ["kpi"]),
    "kpi_summary_period": Query(
        SUMMARY_COLUMNS,
        lambda d: R.kpi_summary(kpi_of(d), 7, "2024-01-08", "2024-01-21"),
        SUMMARY_SQL + " where employee_id = 7 and work_date between date '2024-01-08' and date '2024-01-21'",
        ["kpi"],
    ),
    "kpi_summary_published": Query(
        SUMMARY_COLUMNS,
        lambda d: R.rounded_summary(R.kpi_summary(kpi_of(d))),
        f"""select working_days, total_remote_sessions, vehicle_days,
                   {_signed('avg_efficiency_rate')}, {_signed('total_profit_loss')},
                   {_signed('total_billable_hours')}, {_signed('avg_onsite_hours')},
                   {_signed('avg_travel_hours')}, {_signed('remote_vs_onsite_ratio')}
            from ({SUMMARY_SQL})""",
        ["kpi"],
    ),
    "client_profitability": Query(
        CLIENT_COLUMNS,
        lambda d: R.client_profitability(d.clients, d.timesheets, kpi_of(d)),
        CLIENT_SQL.format(visits="(select distinct client_id, employee_id, work_date from timesheets)"),
        ["clients", "timesheets", "kpi"],
    ),
    "client_profitability_row_level": Query(
        CLIENT_COLUMNS,
        lambda d: R.client_profitability(d.clients, d.timesheets, kpi_of(d), faithful=True),
        CLIENT_SQL.format(visits="timesheets"),
        ["clients", "timesheets", "kpi"],
    ),
    "vehicle_efficiency": Query(
        "vehicle_id vehicle_name:text users uses avg_hours:num estimated_cost:num",
        lambda d: R.vehicle_efficiency(d.vehicles, d.vehicle_log),
        VEHICLE_SQL.format(log="vehicle_log"),
        ["vehicles", "vehicle_log"],
    ),
    "vehicle_efficiency_period": Query(
        "vehicle_id vehicle_name:text users uses avg_hours:num estimated_cost:num",
        lambda d: R.vehicle_efficiency(d.vehicles, d.vehicle_log, "2024-01-08", "2024-01-14"),
        VEHICLE_SQL.format(
            log="(select * from vehicle_log where work_date between date '2024-01-08' and date '2024-01-14')"
        ),
        ["vehicles", "vehicle_log"],
    ),
    "monthly_trends": Query(
        "year month active_employees avg_efficiency_rate:num profit_loss:num billable_hours:num "
        "remote_sessions onsite_percentage:num",
        lambda d: R.monthly_trends(kpi_of(d), AS_OF, 6),
        """select year(work_date) as year, month(work_date) as month, count(distinct employee_id) as active_employees,
                  sum(efficiency_rate)::double / count(*)::double as avg_efficiency_rate,
                  sum(profit_loss) as profit_loss, sum(billable_hours) as billable_hours,
                  sum(remote_sessions) as remote_sessions,
                  sum(share)::double / (count(share) * 1000000)::double as onsite_percentage
           from (select *, floor(onsite_hours::double / nullif(onsite_hours + travel_hours, 0)::double * 100.0::double
                                 * 1000000.0::double + 0.5::double)::bigint as share from kpi)
           where work_date >= date '2023-07-31' group by all""",
        ["kpi"],
    ),
    "top_performers": Query(
        "employee_id full_name:text avg_efficiency_rate:num profit_loss:num billable_hours:num "
        "working_days remote_sessions",
        lambda d: R.top_performers(d.employees, kpi_of(d), limit=10),
        """select employee_id, full_name, sum(efficiency_rate)::double / count(*)::double as avg_efficiency_rate,
                  sum(profit_loss) as profit_loss, sum(billable_hours) as billable_hours,
                  count(*) as working_days, sum(remote_sessions) as remote_sessions
           from kpi join employees using (employee_id) group by employee_id, full_name
           order by profit_loss desc, avg_efficiency_rate desc, employee_id limit 10""",
        ["kpi", "employees"],
    ),
    "alert_counts": Query(
        "efficiency_warnings efficiency_critical profit_warnings insufficient_hours total",
        lambda d: R.alert_counts(kpi_of(d)),
        """select *, efficiency_warnings + efficiency_critical + profit_warnings + insufficient_hours as total
           from (select count(*) filter (where efficiency_rate < 70) as efficiency_warnings,
                        count(*) filter (where efficiency_rate < 50) as efficiency_critical,
                        count(*) filter (where profit_loss < -20) as profit_warnings,
                        count(*) filter (where billable_hours < 7) as insufficient_hours from kpi)""",
        ["kpi"],
    ),
    "performance_series": Query(
        "work_date:text label:text efficiency_rate:num profit_loss:num billable_hours:num active_employees",
        lambda d: R.performance_series(kpi_of(d), "2024-02-03", 14),
        """select day::date as work_date, strftime(day, '%d/%m') as label,
                  coalesce(sum(efficiency_rate)::double / nullif(count(employee_id), 0)::double, 0) as efficiency_rate,
                  coalesce(sum(profit_loss), 0) as profit_loss, coalesce(sum(billable_hours), 0) as billable_hours,
                  count(employee_id) as active_employees
           from generate_series(date '2024-01-20', date '2024-02-03', interval 1 day) as g(day)
           left join kpi on work_date = day::date group by day""",
        ["kpi"],
    ),
    "daily_performance": Query(
        PERFORMANCE_COLUMNS,
        lambda d: R.daily_performance(d.employees, kpi_of(d), d.absences, anomalies_of(d)),
        """select employee_id, full_name, work_date, timesheet_hours, billable_hours, efficiency_rate, profit_loss,
                  k.daily_cost, revenue,
                  case when billable_hours < 7 and absences is null then 'ALERT'
                       when efficiency_rate < 70 then 'WARNING' else 'OK' end as status,
                  coalesce(open, 0) as anomaly_count
           from kpi k join employees using (employee_id)
           left join abs_days using (employee_id, work_date)
           left join (select employee_id, work_date, count(*) as open from anomalies where not resolved group by all)
             using (employee_id, work_date)""",
        ["kpi", "employees", "abs_days", "anomalies"],
    ),
    "daily_performance_row_level": Query(
        PERFORMANCE_COLUMNS,
        lambda d: R.daily_performance(d.employees, kpi_of(d), d.absences, anomalies_of(d), faithful=True),
        """select e.employee_id, e.full_name, k.work_date, any_value(timesheet_hours) as timesheet_hours,
                  any_value(billable_hours) as billable_hours, any_value(efficiency_rate) as efficiency_rate,
                  any_value(profit_loss) as profit_loss, any_value(k.daily_cost) as daily_cost,
                  any_value(revenue) as revenue,
                  any_value(case when billable_hours < 7 and ra.id is null then 'ALERT'
                       when efficiency_rate < 70 then 'WARNING' else 'OK' end) as status,
                  count(a.type) as anomaly_count
           from employees e left join kpi k using (employee_id)
           left join absences ra on ra.employee_id = e.employee_id and ra.from_date <= k.work_date
             and ra.to_date >= k.work_date and ra.state = 'approved'
           left join anomalies a on a.employee_id = e.employee_id and a.work_date = k.work_date and not a.resolved
           where e.active group by e.employee_id, e.full_name, k.work_date""",
        ["kpi", "employees", "absences", "anomalies"],
    ),
    "correlation_metrics": Query(
        "employee_id work_date:text timesheet_hours:num activity_hours:num calendar_hours:num "
        "activity_gap:num calendar_gap:num correlation_score",
        lambda d: R.correlation_metrics(kpi_of(d)),
        f"""select employee_id, work_date, timesheet_hours, activity_hours, calendar_hours,
                   abs(timesheet_hours - activity_hours) as activity_gap,
                   abs(timesheet_hours - calendar_hours) as calendar_gap, {SCORE} as correlation_score
            from kpi where timesheet_hours > 0""",
        ["kpi"],
    ),
    "correlation_by_employee": Query(
        "employee_id correlation_score:num",
        lambda d: R.correlation_by_employee(kpi_of(d)),
        CORRELATION_SQL,
        ["kpi"],
    ),
    "health_scores": Query(
        "employee_id open_anomalies correlation_score:num health_score:num",
        lambda d: R.health_scores(d.employees, kpi_of(d), anomalies_of(d)),
        f"""select employee_id, coalesce(open, 0) as open_anomalies, coalesce(correlation_score, 0) as correlation_score,
                   greatest(0.0, least(100.0, 100.0::double - coalesce(open, 0) * 5.0::double
                                       - (100.0::double - coalesce(correlation_score, 0)))) as health_score
            from employees left join ({CORRELATION_SQL}) using (employee_id)
            left join (select employee_id, count(*) as open from anomalies where not resolved group by all)
              using (employee_id)""",
        ["employees", "kpi", "anomalies"],
    ),
    "anomaly_stats": Query(
        "type:text severity:text total unresolved",
        lambda d: R.anomaly_stats(anomalies_of(d)),
        """select type, severity, count(*) as total, count(*) filter (where not resolved) as unresolved
           from anomalies group by all""",
        ["anomalies"],
    ),
    "calculation_progress": Query(
        "current_rows total_days active_employees expected_rows progress:num",
        lambda d: R.calculation_progress(d.timesheets, d.employees, kpi_of(d)),
        """select current_rows, total_days, active_employees, total_days * active_employees as expected_rows,
                  floor(current_rows::double / (total_days * active_employees)::double * 100.0::double
                        * 10.0::double + 0.5::double) / 10.0::double as progress
           from (select (select count(*) from kpi) as current_rows, (select hi - lo + 1 from bounds) as total_days,
                        (select count(*) from employees where active) as active_employees)""",
        ["kpi", "bounds", "employees"],
    ),
}
