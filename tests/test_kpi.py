"""Hand-made edge rows for the KPI measures."""

from decimal import Decimal as D

import pytest

from conftest import day, rows, ts
from shiftlens.operators import kpi as K
from shiftlens.settings import Settings

SPAN = "id long, employee_id long, start_ts timestamp, end_ts timestamp, duration_hours decimal(5,2), billable boolean"


def frames(spark, sheets=(), acts=(), cal=(), remote=(), cars=()):
    return dict(
        employees=spark.createDataFrame(
            [(1, D("100"), True), (2, None, True), (3, D("90"), False)],
            "employee_id long, daily_cost decimal(8,2), active boolean",
        ),
        timesheets=spark.createDataFrame(
            list(sheets), "id long, employee_id long, client_id long, work_date date, hours decimal(5,2)"
        ),
        activities=spark.createDataFrame(list(acts), SPAN),
        calendar=spark.createDataFrame(list(cal), "id long, employee_id long, start_ts timestamp, end_ts timestamp"),
        remote_sessions=spark.createDataFrame(list(remote), "id long, employee_id long, start_ts timestamp"),
        vehicle_log=spark.createDataFrame(
            list(cars), "id long, employee_id long, work_date date, pickup_ts timestamp, return_ts timestamp"
        ),
        clients=spark.createDataFrame([(7,)], "client_id long"),
    )


def kpi(spark, settings=None, lo="2025-06-03", hi="2025-06-03", **kw):
    df = K.daily_kpi(**frames(spark, **kw), date_from=lo, date_to=hi, settings=settings)
    return {(r.employee_id, str(r.work_date)): r for r in df.collect()}


def act(start, end, hours="1.50", billable=True):
    return (1, 1, ts(start), ts(end), D(hours), billable)


def test_spine_has_every_active_employee_and_day(spark):
    got = kpi(spark, lo="2025-06-01", hi="2025-06-04")
    assert len(got) == 8 and {e for e, _ in got} == {1, 2}
    assert all(r.efficiency_rate == 0 and r.profit_loss == -r.daily_cost for r in got.values())
    assert got[(2, "2025-06-01")].daily_cost == D("80.00")


def test_default_period_is_the_span_of_the_timesheets(spark):
    f = frames(spark, sheets=[(1, 1, 7, day("2025-06-02"), D("8")), (2, 1, None, day("2025-06-04"), D("8"))])
    assert K.daily_kpi(**f).count() == 2 * 3


def test_three_day_span_shares_duration(spark):
    df = K.activity_hours(
        spark.createDataFrame([act("2025-06-01 18:00", "2025-06-03 06:00", "9.00")], SPAN)
    )
    got = rows(df)
    assert [r[2] for r in got] == [6_000_000, 24_000_000, 6_000_000]
    assert sum(r[3] for r in got) == 9_000_000
    assert [r[3] for r in got] == [1_500_000, 6_000_000, 1_500_000]


@pytest.mark.parametrize(
    "start,end,expected",
    [
        ("2025-06-01 23:59:40", "2025-06-02 00:00:10", [("2025-06-01", 0, None), ("2025-06-02", 0, None)]),
        ("2025-06-01 22:00", "2025-06-02 00:00", [("2025-06-01", 2_000_000, 1_500_000), ("2025-06-02", 0, 0)]),
        ("2025-06-01 09:00", "2025-06-01 23:00", [("2025-06-01", 1_500_000, 1_500_000)]),
        ("2025-06-02 09:00", "2025-06-01 09:00", []),
    ],
)
def test_day_split_edges(spark, start, end, expected):
    df = K.activity_hours(spark.createDataFrame([act(start, end)], SPAN))
    assert [(str(r[1]), r[2], r[3]) for r in rows(df)] == expected


def test_not_billable_counts_as_activity_only(spark):
    got = kpi(spark, acts=[act("2025-06-03 09:00", "2025-06-03 10:30", billable=False)])[(1, "2025-06-03")]
    assert got.activity_hours == D("1.50") and got.billable_hours == 0 and got.revenue == 0


def test_clipping_to_the_period_changes_no_share(spark):
    span = [act("2025-06-01 18:00", "2025-06-03 06:00", "9.00")]
    whole = {r[1]: r[2:] for r in rows(K.activity_hours(spark.createDataFrame(span, SPAN)))}
    part = rows(K.activity_hours(spark.createDataFrame(span, SPAN), "2025-06-02", "2025-06-02"))
    assert [(r[1], r[2:]) for r in part] == [(day("2025-06-02"), whole[day("2025-06-02")])]


def test_efficiency_base(spark):
    d = day("2025-06-03")
    both = kpi(spark, sheets=[(1, 1, 7, d, D("6"))], acts=[act("2025-06-03 09:00", "2025-06-03 10:30", "8")])
    assert both[(1, "2025-06-03")].efficiency_rate == D("100.00")
    only = kpi(spark, acts=[act("2025-06-03 09:00", "2025-06-03 10:30", "2")])[(1, "2025-06-03")]
    assert only.efficiency_rate == D("100.00")
    sheet = kpi(spark, sheets=[(1, 1, 7, d, D("6"))])[(1, "2025-06-03")]
    assert sheet.efficiency_rate == 0 and sheet.onsite_hours == D("6.00")
    cap = kpi(spark, acts=[act("2025-06-02 23:50", "2025-06-03 00:10", "10")])[(1, "2025-06-03")]
    assert cap.efficiency_rate == D("150.00")


def test_money_and_side_measures(spark):
    d = day("2025-06-03")
    got = kpi(
        spark,
        sheets=[(1, 1, 7, d, D("4")), (2, 1, 99, d, D("3")), (3, 1, None, d, D("1"))],
        acts=[act("2025-06-03 09:00", "2025-06-03 10:30", "3")],
        remote=[(1, 1, ts("2025-06-03 23:59")), (2, 1, ts("2025-06-04 00:00"))],
        cars=[(1, 1, d, ts("2025-06-03 08:00"), ts("2025-06-03 09:30")), (2, 1, d, ts("2025-06-03 10:00"), None)],
        cal=[(1, 1, ts("2025-06-02 23:00"), ts("2025-06-03 01:00"))],
    )[(1, "2025-06-03")]
    assert (got.timesheet_hours, got.onsite_hours, got.calendar_hours) == (D("8.00"), D("4.00"), D("1.00"))
    assert (got.revenue, got.profit_loss) == (D("150.00"), D("50.00"))
    assert (got.remote_sessions, got.travel_hours, got.vehicle_usage) == (1, D("1.50"), 1)


def codes(row):
    return sorted(a.code for a in row.alerts)


def test_alert_rules(spark):
    d = day("2025-06-03")
    a = act("2025-06-03 09:00", "2025-06-03 10:30", "5")
    assert codes(kpi(spark, sheets=[(1, 1, 7, d, D("4"))], acts=[a])[(1, "2025-06-03")]) == ["billable_exceeds_timesheet"]
    b = act("2025-06-03 09:00", "2025-06-03 10:30", "5.01", False)
    assert codes(kpi(spark, sheets=[(1, 1, 7, d, D("4"))], acts=[b])[(1, "2025-06-03")]) == ["timesheet_activity_mismatch"]
    c = [(1, 1, ts("2025-06-03 09:00"), ts("2025-06-03 10:00"))]
    assert codes(kpi(spark, cal=c)[(1, "2025-06-03")]) == ["missing_timesheet"]
    assert codes(kpi(spark, acts=[a])[(1, "2025-06-03")]) == ["billable_without_timesheet"]
    late = act("2025-06-02 23:00", "2025-06-03 01:00", "2.40")
    r = kpi(spark, acts=[late])[(1, "2025-06-03")]
    assert r.efficiency_rate == D("120.00") and "high_efficiency" not in codes(r)
    late = act("2025-06-02 23:00", "2025-06-03 01:00", "2.42")
    assert "high_efficiency" in codes(kpi(spark, acts=[late])[(1, "2025-06-03")])


def test_alert_anomalies_take_severity_from_level(spark):
    f = frames(spark, acts=[act("2025-06-02 23:00", "2025-06-03 01:00", "2.42")])
    df = K.alert_anomalies(K.daily_kpi(**f, date_from="2025-06-03", date_to="2025-06-03"))
    assert rows(df.select("type", "severity")) == [
        ("billable_without_timesheet", "high"),
        ("high_efficiency", "medium"),
    ]


def test_settings_change_the_rate(spark):
    s = Settings(hourly_rate=D("10"), default_daily_cost=D("1"))
    got = kpi(spark, settings=s, acts=[act("2025-06-03 09:00", "2025-06-03 10:30", "3")])
    assert got[(1, "2025-06-03")].revenue == D("30.00") and got[(2, "2025-06-03")].daily_cost == D("1.00")


def test_single_exchange_for_all_feeds(spark):
    f = frames(spark)
    # without adaptive re-planning the plan shows its exchanges
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = K.daily_kpi(**f, date_from="2025-06-01", date_to="2025-06-03")
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning(employee_id") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
