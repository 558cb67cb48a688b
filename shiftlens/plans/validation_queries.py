"""Queries over the validators and the anomaly rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.operators import validators as V
from shiftlens.plans.domain import Domain
from shiftlens.plans.registry import Query
from shiftlens.settings import Settings

S = Settings()
ANOMALY = "employee_id work_date:text type:text severity:text description:text details:text"


def _ledger(d: Domain) -> DataFrame:
    return V.day_ledger(d.timesheets, d.activities, d.calendar, d.remote_sessions, d.absences)


def _rule(d: Domain, rule: Column) -> DataFrame:
    return V.day_rule_anomalies(_ledger(d), d.employees, [rule])


def raw_anomalies(d: Domain, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    return V.validate_all(
        d.employees, d.timesheets, d.activities, d.calendar, d.remote_sessions, d.vehicle_log,
        d.absences, d.clients, date_from, date_to,
    )


def anomalies_of(d: Domain) -> DataFrame:
    """Anomaly rows with a resolution flag."""
    resolved = (F.col("employee_id") + F.day("work_date")) % 3 == 0
    return raw_anomalies(d).withColumn("resolved", resolved)


def _faithful_hours(d: Domain) -> DataFrame:
    return _rule(d, V.hours_mismatch(S, faithful=True)).select("employee_id", "work_date", "severity")


def _of_type(name: str) -> str:
    return f"select * from anomalies_raw where type = '{name}'"


QUERIES = {
    "hours_mismatch": Query(
        ANOMALY, lambda d: _rule(d, V.hours_mismatch(S)), _of_type("hours_mismatch"), ["anomalies_raw"]
    ),
    "hours_mismatch_row_level": Query(
        "employee_id work_date:text severity:text",
        _faithful_hours,
        """select employee_id, work_date,
                  case when gap > 3000000 then 'high' when gap > 2000000 then 'medium' else 'low' end as severity
           from v_hours_faithful where gap > 1000000""",
        ["v_hours_faithful"],
    ),
    "overlapping_punches": Query(
        ANOMALY, lambda d: V.overlaps(d.timesheets, d.employees), _of_type("overlaps"), ["anomalies_raw"]
    ),
    "travel_mismatch": Query(
        "employee_id work_date:text client_id worked_client:text car_client_id car_client:text occurrences",
        lambda d: V.travel_mismatches(d.timesheets, d.vehicle_log, d.clients, d.employees),
        "select * from v_travel",
        ["v_travel"],
    ),
    "orphan_sessions": Query(
        ANOMALY, lambda d: _rule(d, V.orphan_sessions()), _of_type("orphan_sessions"), ["anomalies_raw"]
    ),
    "insufficient_hours": Query(
        ANOMALY, lambda d: _rule(d, V.insufficient_hours(S)), _of_type("insufficient_hours"), ["anomalies_raw"]
    ),
    "missing_reports": Query(
        ANOMALY, lambda d: _rule(d, V.missing_reports()), _of_type("missing_reports"), ["anomalies_raw"]
    ),
    "absence_days": Query(
        "employee_id work_date:text absences",
        lambda d: V.absence_days(d.absences),
        "select * from abs_days",
        ["abs_days"],
    ),
    "validate_all": Query(ANOMALY, raw_anomalies, "select * from anomalies_raw", ["anomalies_raw"]),
    "validate_all_period": Query(
        ANOMALY,
        lambda d: raw_anomalies(d, "2024-01-08", "2024-01-14"),
        "select * from anomalies_raw where work_date between date '2024-01-08' and date '2024-01-14'",
        ["anomalies_raw"],
    ),
    "open_anomalies": Query(
        ANOMALY,
        lambda d: V.open_anomalies(anomalies_of(d)),
        "select * from anomalies where not resolved",
        ["anomalies"],
    ),
}
