"""KPI rows and anomalies kept up to date as facts arrive, day by day.

Every fact (a punch, an activity, ..) adds to a few (employee, day) keys; a span of several days
adds to each of them.  What it adds is stored as rows of its own in one table partitioned by day.
A batch of new or changed facts then

1. finds the earlier version of each fact in the partition of its start day, and with it the keys
   that either version touches;
2. replaces the facts' rows in the partitions of those days;
3. sums the rows of the touched keys again, and replaces their KPI rows and anomalies; anomalies
   that no longer hold and were not resolved are removed.

Only partitions of touched days are read and written.  A fact is named by its feed, its id and its
start day; the same fact sent again, in the same batch or later, replaces itself.  The touched keys
are written down before anything is changed, so a batch that is run again after a failure does the
rest of its work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shiftlens.operators import kpi as K, validators as V
from shiftlens.operators.common import union_all
from shiftlens.session import cut_lineage
from shiftlens.settings import Settings
from shiftlens.sinks import upsert as U

KEYS = ["employee_id", "work_date"]
FACT = ["feed", "fact", "home"]
KEEP = (*FACT, "last")
LONGEST_SPAN = 3660


def _days_of(feed: str) -> tuple[Column, Column]:
    """First and last day a fact touches."""
    if feed in ("timesheets", "vehicle_log"):
        return F.col("work_date"), F.col("work_date")
    if feed == "absences":
        return F.col("from_date"), F.greatest("from_date", "to_date")
    start = F.to_date("start_ts")
    if feed == "remote_sessions":
        return start, start
    return start, F.greatest(start, F.to_date("end_ts"))


def stamped(feed: str, rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with feed, fact (the text of the key columns), home and last; one row per fact, the
    greatest by its columns.

    Rows without a start are left out, and rows without an employee add to nobody; a span of over
    ten years is an error.
    """
    home, last = _days_of(feed)
    fact = F.col(key[0]).cast("string") if len(key) == 1 else F.to_json(F.struct(*key))
    text = F.concat(F.lit(f"{feed} "), fact, F.lit(f" spans more than {LONGEST_SPAN} days"))
    last = F.when(F.datediff(last, home) > LONGEST_SPAN, F.raise_error(text)).otherwise(last)
    named = rows.where(home.isNotNull()).select(
        "*", F.lit(feed).alias("feed"), fact.alias("fact"), home.alias("home"), last.alias("last")
    )
    return U.last_per_key(named, FACT, [c for c in named.columns if c not in FACT])


def contributions(feed: str, rows: DataFrame, clients: DataFrame) -> list[DataFrame]:
    """What stamped facts add to KPI measures and to the day ledger; timesheets and vehicle rows
    also carry what the overlap and travel rules compare."""
    if feed == "timesheets":
        raw = ("start_ts", "end_ts", "client_id")
        return [K.timesheet_rows(rows, *KEEP), K.onsite_rows(rows, clients, *KEEP), V.sheet_entries(rows, *KEEP, *raw)]
    if feed == "activities":
        return [K.activity_rows(rows, keep=KEEP), V.work_entries(rows, *KEEP)]
    if feed == "calendar":
        return [K.calendar_rows(rows, keep=KEEP), V.planned_entries(rows, *KEEP)]
    if feed == "remote_sessions":
        return [K.remote_rows(rows, *KEEP), V.session_entries(rows, *KEEP)]
    if feed == "vehicle_log":
        return [K.vehicle_rows(rows, *KEEP, "client_id")]
    if feed == "absences":
        return [V.absence_entries(rows, keep=KEEP)]
    raise ValueError(f"no such feed: {feed}")


CONTRIBUTION = (
    "employee_id bigint, work_date date, feed string, fact string, home date, last date, "
    + ", ".join(f"{m} bigint" for m in [*K.MEASURES, *V.LEDGER])
    + ", start_ts timestamp, end_ts timestamp, client_id bigint"
)


def _shaped(rows: DataFrame, ddl: str) -> DataFrame:
    """All columns of ``ddl`` in its order and types; those that are missing are NULL."""
    wanted = [c.strip().split() for c in ddl.split(",")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted])


def _markers(days: DataFrame, ddl: str) -> DataFrame:
    """One row without a key per day: a partition all of whose rows went is still replaced."""
    return _shaped(days.select("work_date").distinct(), ddl)


ANOMALY = (
    "employee_id bigint, work_date date, type string, severity string, description string, details string, "
    "findings bigint, resolved boolean, note string, resolved_by bigint, resolved_at timestamp"
)


@dataclass
class DailyTables:
    """The tables under ``root``: what facts add, KPI rows and anomalies, all partitioned by day.

    ``employees`` and ``clients`` are the dimensions as they are now.  ``as_of``: no timesheet may be
    dated later.  A client or an employee's state that changes afterwards does not change rows that
    were summed before; send the facts again, or rebuild.
    """

    spark: SparkSession
    root: str
    employees: DataFrame
    clients: DataFrame
    settings: Settings | None = None
    as_of: str | None = None
    validate: bool = True  # keep the anomalies too

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _table(self, name: str, ddl: str) -> DataFrame:
        if U.table_exists(self.spark, self.path(name)):
            return self.spark.read.schema(ddl).parquet(self.path(name))
        return self.spark.createDataFrame([], ddl)

    def kpi(self) -> DataFrame:
        return self.spark.read.parquet(self.path("kpi"))

    def anomalies(self) -> DataFrame:
        return self._table("anomalies", ANOMALY).where("employee_id is not null")

    def stored(self, days: DataFrame) -> DataFrame:
        """Stored contributions in the partitions of ``days``, and no others."""
        found = U.in_partitions(self._table("contributions", CONTRIBUTION), days, "work_date")
        return found.where("employee_id is not null")

    def _held(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` as a table of this batch, which the next batch replaces."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self.path(name))
        return self.spark.read.schema(rows.schema).parquet(self.path(name))

    # ------------------------------------------------------------ one batch

    def apply(self, batch: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> None:
        """Take in a batch: feed name -> rows of that feed, new or changed.  ``keys`` names the columns
        by which the rows of a feed are told apart, beside their start day; ``id`` where it is silent."""
        rows = {feed: stamped(feed, frame, (keys or {}).get(feed, ["id"])) for feed, frame in batch.items()}
        if not rows:
            return
        rows = {feed: self._held(frame, f"batch_{feed}") for feed, frame in rows.items()}
        new = self._held(
            union_all([_shaped(part, CONTRIBUTION) for f, r in rows.items() for part in contributions(f, r, self.clients)])
            .where("employee_id is not null"),
            "batch_contributions",
        )
        facts = union_all([r.select(*KEEP, "employee_id") for r in rows.values()])
        pending = self._table("pending", "employee_id bigint, work_date date")
        if facts.isEmpty() and pending.isEmpty():
            return
        touched = cut_lineage(self._touched(facts).unionByName(pending).distinct())
        touched.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self.path("pending"))
        self._replace(new, facts, touched)
        spine = cut_lineage(self._spine(facts, touched))
        kpi = cut_lineage(self._kpi_of(spine))
        if not kpi.isEmpty():
            U.upsert_table(kpi, self.path("kpi"), self.path("kpi_staging"), KEYS, "work_date")
        if self.validate:
            self._replace_anomalies(touched.unionByName(spine.select(*KEYS)).distinct(), kpi)
        self._finish(facts)

    def _touched(self, facts: DataFrame) -> DataFrame:
        """Keys that the facts, or the earlier versions of them, add to."""
        homes = facts.select(F.col("home").alias("work_date"))
        before = self.stored(homes).where("work_date = home").select(*KEEP, "employee_id").distinct()
        before = before.join(facts.select(*FACT).hint("merge"), FACT, "left_semi")  # facts grow with the batch
        every = facts.where("employee_id is not null").unionByName(before)
        return every.select("employee_id", F.explode(F.sequence("home", F.greatest("home", "last"))).alias("work_date")).distinct()

    def _replace(self, new: DataFrame, facts: DataFrame, touched: DataFrame) -> None:
        others = self.stored(touched).join(facts.select(*FACT).hint("merge"), FACT, "left_anti")
        rows = others.unionByName(new).unionByName(_markers(touched, CONTRIBUTION))
        self._write(rows, "contributions")

    def _write(self, rows: DataFrame, name: str) -> None:
        staging = self.path(f"{name}_staging")
        U._write(U.by_partition(rows, "work_date"), staging, "work_date")
        U._write(self.spark.read.schema(rows.schema).parquet(staging), self.path(name), "work_date", "dynamic")

    # ------------------------------------------------------------ KPI rows

    def _bounds(self, facts: DataFrame) -> DataFrame:
        """(lo, hi): first and last day of all timesheets so far."""
        sheets = facts.where("feed = 'timesheets'").select(F.col("home").alias("lo"), F.col("home").alias("hi"), "fact")
        if self.as_of is not None:
            text = F.concat(F.lit("timesheet "), "fact", F.lit(" is dated "), F.col("hi").cast("string"), F.lit(f", after {self.as_of}"))
            sheets = sheets.withColumn("hi", F.when(F.col("hi") > F.lit(self.as_of).cast("date"), F.raise_error(text)).otherwise(F.col("hi")))
        known = self._table("bounds", "lo date, hi date")
        return sheets.drop("fact").unionByName(known).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def _spine(self, facts: DataFrame, touched: DataFrame) -> DataFrame:
        """Keys whose KPI rows are to be made (employee_id, work_date, own_cost): touched ones, those
        of days that came into the period, and those of employees that were not there before."""
        lo, hi = self._bounds(facts).first()
        empty = "employee_id bigint, work_date date, own_cost decimal(8,2)"
        if lo is None:
            return self.spark.createDataFrame([], empty)
        old = self._table("bounds", "lo date, hi date").first()
        active = self.employees.where("active").select("employee_id", F.col("daily_cost").alias("own_cost"))
        known = self._table("people", "employee_id bigint").withColumn("known", F.lit(True))
        people = active.join(known, "employee_id", "left")
        days = F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("work_date")
        all_days = people.select("employee_id", "own_cost", "known", days)
        fresh = F.col("known").isNull()
        if old is not None:
            fresh = fresh | (F.col("work_date") < F.lit(old.lo)) | (F.col("work_date") > F.lit(old.hi))
        else:
            fresh = F.lit(True)
        in_period = touched.where(F.col("work_date").between(lo, hi)).join(active, "employee_id")
        return all_days.where(fresh).select(*KEYS, "own_cost").unionByName(in_period.select(*KEYS, "own_cost")).distinct()

    def _kpi_of(self, spine: DataFrame) -> DataFrame:
        marked = spine.select(*KEYS, "own_cost", F.lit(1).alias("on_spine"))
        added = self.stored(spine).select(*KEYS, *K.MEASURES)
        return K.kpi_rows(K.summed([marked, added]), self.settings or Settings())

    # ------------------------------------------------------------ anomalies

    def _found(self, keys: DataFrame, kpi: DataFrame) -> DataFrame:
        """Anomalies of the keys as the stored facts are now."""
        s = self.settings or Settings()
        rows = self.stored(keys).join(keys.select(*KEYS).distinct().hint("merge"), KEYS, "left_semi")
        rows = self._held(rows, "batch_rows")  # for the ledger, the overlaps and the travels
        ledger = V.summed_entries([rows.select(*KEYS, *V.LEDGER)])
        rules = [V.hours_mismatch(s), V.orphan_sessions(), V.insufficient_hours(s), V.missing_reports()]
        sheets, cars = rows.where("feed = 'timesheets' and punches = 1"), rows.where("feed = 'vehicle_log'")
        return union_all(
            [
                V.day_rule_anomalies(ledger, self.employees, rules),
                V.overlaps(sheets, self.employees),
                V.travel(sheets, cars, self.clients, self.employees),
                K.alert_anomalies(kpi),
            ]
        )

    def _replace_anomalies(self, keys: DataFrame, kpi: DataFrame) -> None:
        keys = cut_lineage(keys)
        found = cut_lineage(U.one_per_anomaly_key(self._found(keys, kpi)))
        stored = U.in_partitions(self._table("anomalies", ANOMALY), keys, "work_date").where("employee_id is not null")
        gone = stored.where("not resolved").join(keys, KEYS, "left_semi").join(found, U.ANOMALY_KEYS, "left_anti")
        kept = stored.join(gone.select(*U.ANOMALY_KEYS), U.ANOMALY_KEYS, "left_anti")
        merged = U.upsert_columns(kept, found.withColumn("resolved", F.lit(False)), U.ANOMALY_KEYS, U.ANOMALY_REFRESH)
        self._write(_shaped(merged, ANOMALY).unionByName(_markers(keys, ANOMALY)), "anomalies")

    # ------------------------------------------------------------ what is known for the next batch

    def _finish(self, facts: DataFrame) -> None:
        bounds, people = cut_lineage(self._bounds(facts)), self.employees.where("active").select("employee_id")
        for name, rows in (("bounds", bounds.where("lo is not null")), ("people", people)):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self.path(name))
        self.spark.createDataFrame([], "employee_id bigint, work_date date").write.mode("overwrite").option(
            "partitionOverwriteMode", "static"
        ).parquet(self.path("pending"))
