"""Validator rules on hand-made rows; overlaps against brute force."""

import datetime as dt
from decimal import Decimal as D

from hypothesis import HealthCheck, given, settings, strategies as st

from conftest import day, rows, ts
from shiftlens.operators.common import meets, starts_within
from shiftlens.operators import validators as V
from shiftlens.settings import Settings

SHEET = "id long, employee_id long, client_id long, work_date date, start_ts timestamp, end_ts timestamp, hours decimal(5,2)"
ACT = "id long, employee_id long, start_ts timestamp, duration_hours decimal(5,2), description string"
CAL = "id long, employee_id long, start_ts timestamp, end_ts timestamp"
REM = "id long, employee_id long, start_ts timestamp"
ABS = "id long, employee_id long, from_date date, to_date date, state string"
DAY = "2025-06-03"


def people(spark):
    return spark.createDataFrame([(1, True), (2, True), (3, False)], "employee_id long, active boolean")


def punch(i, e, hours, client=None, start="09:00", end="10:00"):
    return (i, e, client, day(DAY), ts(f"{DAY} {start}"), ts(f"{DAY} {end}"), D(hours))


def fired(spark, rule, sheets=(), acts=(), cal=(), rem=(), absent=()):
    ledger = V.day_ledger(
        spark.createDataFrame(list(sheets), SHEET), spark.createDataFrame(list(acts), ACT),
        spark.createDataFrame(list(cal), CAL), spark.createDataFrame(list(rem), REM),
        spark.createDataFrame(list(absent), ABS),
    )
    return rows(V.day_rule_anomalies(ledger, people(spark), [rule]).select("employee_id", "severity"))


def test_hours_gaps(spark):
    for hours, expected in [("1.00", []), ("1.01", ["low"]), ("2.01", ["medium"]), ("3.01", ["high"])]:
        sheets = [punch(1, 1, "8"), punch(2, 3, "8")]
        acts = [(1, 1, ts(f"{DAY} 09:00"), D("8") - D(hours), None), (2, 3, ts(f"{DAY} 09:00"), D("1"), None)]
        cal = [(1, 1, ts(f"{DAY} 09:00"), ts(f"{DAY} 17:00")), (2, 3, ts(f"{DAY} 09:00"), ts(f"{DAY} 17:00"))]
        got = fired(spark, V.hours_mismatch(Settings()), sheets, acts, cal)
        assert got == [(1, s) for s in expected], hours


def test_two_punches_double_only_in_the_row_level_form(spark):
    sheets = [punch(1, 1, "4"), punch(2, 1, "4")]
    acts = [(1, 1, ts(f"{DAY} 09:00"), D("8"), None)]
    cal = [(1, 1, ts(f"{DAY} 09:00"), ts(f"{DAY} 17:00"))]
    assert fired(spark, V.hours_mismatch(Settings()), sheets, acts, cal) == []
    assert fired(spark, V.hours_mismatch(Settings(), faithful=True), sheets, acts, cal) == [(1, "high")]


def test_insufficient_hours(spark):
    def absent(state, lo=DAY, hi=DAY):
        return (1, 1, day(lo), day(hi), state)

    rule = V.insufficient_hours(Settings())
    assert fired(spark, rule, [punch(1, 1, "6.99")]) == [(1, "high")]
    assert fired(spark, rule, [punch(1, 1, "7.00")]) == []
    assert fired(spark, rule, [punch(1, 1, "6.99")], absent=[absent("approved", "2025-06-01", "2025-06-09")]) == []
    assert fired(spark, rule, [punch(1, 1, "6.99")], absent=[absent("pending")]) == [(1, "high")]
    assert fired(spark, rule, [punch(1, 1, "6.99")], absent=[absent("approved"), absent("approved")]) == []


def test_sessions_and_reports(spark):
    rem = [(1, 1, ts(f"{DAY} 09:00")), (2, 1, ts(f"{DAY} 11:00"))]
    other = [(1, 1, ts(f"{DAY} 08:00"), D("1"), "visita")]
    match = [(1, 1, ts(f"{DAY} 08:00"), D("1"), "Assistenza da REMOTO")]
    assert fired(spark, V.orphan_sessions(), rem=rem, acts=other) == [(1, "medium")]
    assert fired(spark, V.orphan_sessions(), rem=rem, acts=match) == []
    assert fired(spark, V.missing_reports(), [punch(1, 1, "4.01"), punch(2, 2, "4.00")]) == [(1, "high")]
    assert fired(spark, V.missing_reports(), [punch(1, 1, "5")], acts=other) == []


def overlap(spark, spans):
    data = [(i, 1, None, s.date(), s, e, D("1")) for i, (s, e) in enumerate(spans)]
    return sum(r.overlaps for r in V.overlap_counts(spark.createDataFrame(data, SHEET)).collect())


def test_overlap_cases(spark):
    def span(a, b):
        return ts(f"{DAY} {a}"), ts(f"{DAY} {b}")

    assert overlap(spark, [span("09:00", "10:00"), span("10:00", "11:00")]) == 0
    assert overlap(spark, [span("09:00", "12:00"), span("10:00", "11:00")]) == 2
    assert overlap(spark, [span("09:00", "12:00"), span("10:00", "11:00"), span("10:30", "13:00")]) == 6
    assert overlap(spark, [span("09:00", "10:00")] * 3) == 6
    assert overlap(spark, [span("09:00", "10:00"), span("09:30", "09:30"), span("10:00", "10:00")]) == 2
    night = (ts(f"{DAY} 22:00"), ts("2025-06-04 02:00"))
    assert overlap(spark, [night, (ts(f"{DAY} 23:00"), ts("2025-06-04 01:00"))]) == 2


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 12)), min_size=1, max_size=25))
def test_overlaps_equal_all_pairs(spark, spans):
    base = dt.datetime(2025, 6, 3, 8)
    real = [(base + dt.timedelta(minutes=a), base + dt.timedelta(minutes=a + n)) for a, n in spans]
    want = sum(
        1 for i, a in enumerate(real) for j, b in enumerate(real) if i != j and a[0] < b[1] and b[0] < a[1]
    )
    assert overlap(spark, real) == want


def test_travel(spark):
    clients = spark.createDataFrame([(1, "A"), (2, "B")], "client_id long, client_name string")
    log = "id long, employee_id long, client_id long, work_date date"
    cars = spark.createDataFrame([(1, 1, 1, day(DAY)), (2, 1, 2, day(DAY)), (3, 1, 2, day(DAY))], log)
    sheets = spark.createDataFrame(
        [punch(1, 1, "1", 1), punch(2, 1, "1", 1), punch(3, 2, "1", 2), punch(4, 2, "1", None), punch(5, 3, "1", 1)],
        SHEET,
    )
    df = V.travel_mismatches(sheets, cars, clients, people(spark))
    got = rows(df.select("employee_id", "worked_client", "car_client", "occurrences"))
    assert got == [(1, "A", "B", 4), (2, "B", None, 1)]


def test_period_bounds_reach_the_scan(spark, tmp_path):
    schema = "employee_id long, start_ts timestamp, end_ts timestamp, duration_hours decimal(5,2), description string, billable boolean"
    row = (1, ts("2025-06-03 08:00"), ts("2025-06-03 09:00"), None, "x", True)
    spark.createDataFrame([row], schema).write.parquet(str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a"))
    starts = stored.where(starts_within("start_ts", "2025-06-03", "2025-06-03"))
    spans = stored.where(meets("start_ts", "end_ts", "2025-06-03", "2025-06-03"))
    for df, wanted in ((starts, ["GreaterThanOrEqual(start_ts", "LessThan(start_ts"]), (spans, ["Or(IsNull(end_ts),GreaterThanOrEqual(end_ts", "LessTh"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: ")[1].split("]")[0]
        assert all(w in pushed for w in wanted), pushed
        assert df.count() == 1
    assert stored.where(starts_within("start_ts", "2025-06-04", None)).count() == 0
    assert stored.where(starts_within("start_ts", None, "2025-06-02")).count() == 0
