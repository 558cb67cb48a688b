"""Queries over tables that are kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shiftlens.plans.domain import Domain
from shiftlens.plans.kpi_queries import ALERTS_SQL, KPI_COLUMNS
from shiftlens.plans.registry import Query
from shiftlens.plans.sink_queries import ONE_ANOMALY
from shiftlens.session import cut_lineage, working_path
from shiftlens.streaming.incremental import DailyTables

FEEDS = ["timesheets", "activities", "calendar", "remote_sessions", "vehicle_log", "absences"]


def _tables(d: Domain, validate: bool = True) -> DailyTables:
    """Tables over the people and clients, which every batch reads several times: made once."""
    path = working_path(d.spark, "daily")
    employees = cut_lineage(d.employees.select("employee_id", "daily_cost", "active"))
    return DailyTables(d.spark, path, employees, cut_lineage(d.clients), as_of="2024-12-31", validate=validate)


def _feeds(d: Domain) -> dict[str, DataFrame]:
    """The feeds as tables that are written once; every batch takes its rows from them."""
    held = {}
    for feed in FEEDS:
        path, rows = working_path(d.spark, feed), getattr(d, feed)
        rows.write.parquet(path)
        held[feed] = d.spark.read.schema(rows.schema).parquet(path)
    return held


def _kpi_in_batches(d: Domain, batches: int = 8) -> DataFrame:
    """The events come in ``batches`` ranges of their ids, as files of a folder would."""
    tables = _tables(d, validate=False)
    lo, hi = d.table("events").agg(F.min("event_id"), F.max("event_id")).first()
    part = F.expr(f"(id - {lo}) * {batches} div ({hi} - {lo} + 1)")
    feeds = _feeds(d)
    for k in range(batches):
        tables.apply({feed: rows.where(part == k) for feed, rows in feeds.items() if feed != "absences"})
    return tables.kpi()


def _anomalies_with_corrections(d: Domain) -> DataFrame:
    """Events of odd id come with wrong figures first, then those of even id, then the right ones."""
    odd = F.col("id") % 2 == 1
    later = "end_ts + interval 30 hours"
    feeds = _feeds(d)
    wrong = {
        "timesheets": feeds["timesheets"].withColumn("hours", F.expr("cast(hours + 5 as decimal(5,2))")),
        "activities": feeds["activities"].withColumn("end_ts", F.expr(later)).withColumn("employee_id", F.col("employee_id") + 1),
        "calendar": feeds["calendar"].withColumn("end_ts", F.expr(later)),
        "remote_sessions": feeds["remote_sessions"].withColumn("employee_id", F.col("employee_id") + 1),
        "vehicle_log": feeds["vehicle_log"].withColumn("client_id", F.lit(3).cast("long")),
        "absences": feeds["absences"].withColumn("state", F.lit("approved")),
    }
    tables = _tables(d)
    tables.apply({feed: wrong[feed].where(odd) for feed in FEEDS})
    tables.apply({feed: feeds[feed].where(~odd) for feed in FEEDS})
    tables.apply({feed: feeds[feed].where(odd) for feed in FEEDS})
    return tables.anomalies()


QUERIES = {
    "incremental_daily_kpi": Query(KPI_COLUMNS, _kpi_in_batches, "select * from kpi", ["kpi"]),
    "incremental_anomalies": Query(
        "employee_id work_date:text type:text severity:text description:text findings resolved:bool",
        _anomalies_with_corrections,
        f"""select employee_id, work_date, type, severity, description, findings, false as resolved from {ONE_ANOMALY}
            union all
            select employee_id, work_date, code, case level when 'CRITICAL' then 'critical' when 'WARNING' then 'high' else 'medium' end,
                   message, 1, false from ({ALERTS_SQL})""",
        ["anomalies_raw", "measures"],
    ),
}
