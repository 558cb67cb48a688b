"""KPI rows and alerts while facts arrive.

One stateful aggregate over the union of the fact streams holds the measure sums of every (employee,
day) until the watermark has passed the day.  What it updates becomes KPI rows, and the alerts of
these keys are compared with those known before: only changes are reported, an alert that is raised
once, and once more when it is cleared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from shiftlens.operators import kpi as K
from shiftlens.operators.common import union_all
from shiftlens.session import cut_lineage
from shiftlens.settings import Settings
from shiftlens.sinks import upsert as U

KEYS = K.KEYS
ALERT = "employee_id bigint, work_date date, code string, level string, message string"
ROWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "timesheets": K.timesheet_rows,
    "activities": K.activity_rows,
    "calendar": K.calendar_rows,
    "remote_sessions": K.remote_rows,
    "vehicle_log": K.vehicle_rows,
}


def live_measures(feeds: dict[str, DataFrame], clients: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Running measure sums per employee and day (``day_at``) over streams of facts by feed name.

    Facts add up, so each has to come once.  The sums of a day are dropped when the watermark, the
    latest day seen less ``lateness``, has passed it; later facts of the day are left out.
    """
    parts = [ROWS[name](rows) for name, rows in feeds.items()]
    if "timesheets" in feeds:
        parts.append(K.onsite_rows(feeds["timesheets"], clients))
    rows = union_all(parts, fill=True).withColumn("day_at", F.col("work_date").cast("timestamp"))
    present = [m for m in K.MEASURES if m in rows.columns]
    return (
        rows.withWatermark("day_at", lateness)
        .groupBy("employee_id", "day_at")
        .agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in present])
    )


def live_kpi_rows(measures: DataFrame, employees: DataFrame, settings: Settings | None = None) -> DataFrame:
    """KPI rows of updated measure sums, of active employees."""
    active = employees.where("active").select("employee_id", F.col("daily_cost").alias("own_cost"))
    known = {m: F.col(m) if m in measures.columns else F.lit(0).cast("bigint") for m in K.MEASURES}
    rows = measures.withColumn("work_date", F.to_date("day_at")).withColumns(known)
    return K.kpi_rows(rows.join(active, "employee_id"), settings or Settings())


def alert_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Alerts that are in ``now`` and not in ``before`` (raised), and the other way round (cleared)."""
    same = [*KEYS, "code"]
    raised = now.join(before, same, "left_anti").withColumn("change", F.lit("raised"))
    return raised.unionByName(before.join(now, same, "left_anti").withColumn("change", F.lit("cleared")))


def keep_live(
    measures: DataFrame, root: str, employees: Callable[[], DataFrame], checkpoint: str, settings: Settings | None = None
) -> DataStreamWriter:
    """Write KPI rows to ``root``/kpi, open alerts to ``root``/alerts, both by day, and the changes of
    each batch to ``root``/changes/batch=n.

    The changes are written before the open alerts are replaced, and not again when a batch is run
    again, so each change is reported once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kpi = cut_lineage(live_kpi_rows(batch, employees(), settings))
        if kpi.isEmpty():
            return
        U.upsert_table(kpi, f"{root}/kpi", f"{root}/kpi_staging", KEYS, "work_date")
        alerts, log = f"{root}/alerts", f"{root}/changes/batch={batch_id}"
        a = F.col("alert")
        now = kpi.select(*KEYS, F.explode("alerts").alias("alert")).select(*KEYS, a.code.alias("code"), a.level.alias("level"), a.message.alias("message"))
        stored = spark.read.schema(ALERT).parquet(alerts) if U.table_exists(spark, alerts) else spark.createDataFrame([], ALERT)
        stored = U.in_partitions(stored, kpi, "work_date").where("code is not null")
        before = stored.join(kpi.select(*KEYS), KEYS, "left_semi")
        if not U.table_exists(spark, log):
            alert_changes(before, now).write.mode("overwrite").parquet(log)
        days = kpi.select("work_date").distinct()
        empty = days.select(F.lit(None).cast("bigint").alias("employee_id"), "work_date", *[F.lit(None).cast("string").alias(c) for c in ("code", "level", "message")])
        rest = stored.join(kpi.select(*KEYS), KEYS, "left_anti").unionByName(now).unionByName(empty)
        U._write(U.by_partition(rest, "work_date"), f"{alerts}_staging", "work_date")
        U._write(spark.read.schema(rest.schema).parquet(f"{alerts}_staging"), alerts, "work_date", "dynamic")

    return measures.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
