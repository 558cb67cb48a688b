"""Cross-feed validators.

The per-day rules (hours mismatch, orphan sessions, insufficient hours, missing reports)
all look at one (employee, day) at a time, so they share one ledger: every feed is projected
to (employee, day) rows, which are united and aggregated with a single exchange.  Absences
are exploded to days instead of being joined by range.  Overlaps are counted with a sweep
over distinct instants and travel is compared on distinct clients per day, so no rule
ever builds the pairs of a crowded day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftlens.functions import numeric as N, temporal as T
from shiftlens.functions.text import severity_rank
from shiftlens.operators.common import as_date, filtered, starts_within, union_all, within
from shiftlens.settings import Settings

KEYS = ["employee_id", "work_date"]
ANOMALY_COLUMNS = [*KEYS, "type", "severity", "description", "details"]
# Words that mark an activity as remote work.
REMOTE_WORDS = ["remoto", "teamviewer", "remote"]


def _micro(hours: Column) -> Column:
    return (hours.cast("decimal(18,6)") * F.lit(N.MICRO)).cast("bigint")


def _hours(micro: Column) -> Column:
    return N.micro_to_decimal(micro, 2)


def mentions_remote(description: Column, words: list[str] | None = None) -> Column:
    low = F.lower(F.coalesce(description, F.lit("")))
    return low.rlike("|".join(words or REMOTE_WORDS))


def _approved_days(absences: DataFrame, date_from=None, date_to=None) -> DataFrame:
    approved = absences.where(F.col("state") == "approved")
    return T.explode_days(
        approved, F.col("from_date"), F.col("to_date"), "work_date",
        as_date(date_from), as_date(date_to),
    )


def absence_days(absences: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Days covered by approved absences, with the number of absences that cover each."""
    return _approved_days(absences, date_from, date_to).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("absences")
    )


LEDGER = ["ts", "punches", "act", "activities", "remote_activities", "cal", "sessions", "absences"]


def sheet_entries(timesheets: DataFrame, *keep: str) -> DataFrame:
    return timesheets.select(*KEYS, *keep, _micro(F.col("hours")).alias("ts"), F.lit(1).alias("punches"))


def _start_day(*keep: str) -> list:
    return ["employee_id", F.to_date("start_ts").alias("work_date"), *keep]


def work_entries(activities: DataFrame, *keep: str) -> DataFrame:
    return activities.select(
        *_start_day(*keep),
        _micro(F.col("duration_hours")).alias("act"),
        F.lit(1).alias("activities"),
        mentions_remote(F.col("description")).cast("int").alias("remote_activities"),
    )


def planned_entries(calendar: DataFrame, *keep: str) -> DataFrame:
    minutes = T.minutes_between(F.col("start_ts"), F.col("end_ts")).cast("double")
    return calendar.select(*_start_day(*keep), N.to_micro(minutes / F.lit(60.0)).alias("cal"))


def session_entries(remote_sessions: DataFrame, *keep: str) -> DataFrame:
    return remote_sessions.select(*_start_day(*keep), F.lit(1).alias("sessions"))


def absence_entries(absences: DataFrame, date_from=None, date_to=None, keep: tuple = ()) -> DataFrame:
    return _approved_days(absences, date_from, date_to).select(*KEYS, *keep, F.lit(1).alias("absences"))


def summed_entries(parts: list[DataFrame]) -> DataFrame:
    return (
        union_all(parts, fill=True).groupBy(*KEYS).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in LEDGER])
    )


def day_ledger(
    timesheets: DataFrame,
    activities: DataFrame,
    calendar: DataFrame,
    remote_sessions: DataFrame,
    absences: DataFrame,
    date_from=None,
    date_to=None,
) -> DataFrame:
    """What each feed says about an (employee, day); activities and appointments count on
    the day they start.  One exchange for all five feeds."""
    in_period = starts_within("start_ts", date_from, date_to)
    return summed_entries(
        [
            sheet_entries(timesheets.where(within("work_date", date_from, date_to))),
            work_entries(activities.where(in_period)),
            planned_entries(calendar.where(in_period)),
            session_entries(remote_sessions.where(in_period)),
            absence_entries(absences, date_from, date_to),
        ]
    )


def of_active(df: DataFrame, employees: DataFrame) -> DataFrame:
    """Keep rows of active employees.  Applied after aggregation; Spark broadcasts the id
    list only when it has measured it to be small, and splits hot ids otherwise."""
    ids = employees.where("active").select("employee_id")
    return df.join(ids, "employee_id", "left_semi")


# ---------------------------------------------------------------- per-day rules


def _record(kind: str, severity: Column, description: Column, details: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        severity.alias("severity"),
        description.alias("description"),
        F.to_json(details).alias("details"),
    )


def hours_mismatch(s: Settings, faithful: bool = False) -> Column:
    """Timesheet against activities or calendar.  ``faithful`` multiplies both by the number
    of punches of the day, as a row-level join of the three feeds does."""
    ts = F.col("ts")
    times = F.col("punches") if faithful else F.lit(1)
    act, cal = F.col("act") * times, F.col("cal") * times
    gap_act, gap_cal = F.abs(ts - act), F.abs(ts - cal)
    gap = F.greatest(gap_act, gap_cal)
    limit = F.lit(int(s.tolerance_hours * N.MICRO))
    severity = (
        F.when(gap > 3 * N.MICRO, "high").when(gap > 2 * N.MICRO, "medium").otherwise("low")
    )
    text = F.concat(
        F.lit("hours differ: timesheet "), _hours(ts).cast("string"), F.lit("h, activities "),
        _hours(act).cast("string"), F.lit("h, calendar "), _hours(cal).cast("string"), F.lit("h"),
    )
    details = F.struct(
        _hours(ts).alias("timesheet_hours"),
        _hours(act).alias("activity_hours"),
        _hours(cal).alias("calendar_hours"),
        _hours(gap_act).alias("activity_gap"),
        _hours(gap_cal).alias("calendar_gap"),
    )
    fires = (F.col("punches") > 0) & (gap > limit)
    return F.when(fires, _record("hours_mismatch", severity, text, details))


def orphan_sessions() -> Column:
    """Remote sessions on a day without any activity that mentions remote work."""
    fires = (F.col("sessions") > 0) & (F.col("remote_activities") == 0)
    text = F.concat(
        F.col("sessions").cast("string"), F.lit(" remote sessions without a matching activity")
    )
    details = F.struct(F.col("sessions").alias("remote_sessions"), F.lit(0).alias("matching_activities"))
    return F.when(fires, _record("orphan_sessions", F.lit("medium"), text, details))


def insufficient_hours(s: Settings) -> Column:
    """Punched, but less than the minimum, and no approved absence covers the day."""
    limit = F.lit(int(s.min_hours * N.MICRO))
    fires = (F.col("punches") > 0) & (F.col("ts") < limit) & (F.col("absences") == 0)
    text = F.concat(
        F.lit("only "), _hours(F.col("ts")).cast("string"),
        F.lit(f"h of {s.min_hours}h and no approved absence"),
    )
    details = F.struct(
        _hours(F.col("ts")).alias("timesheet_hours"), F.lit(int(s.min_hours)).alias("minimum_hours")
    )
    return F.when(fires, _record("insufficient_hours", F.lit("high"), text, details))


def missing_reports() -> Column:
    """More than four hours punched and no activity started that day."""
    fires = (F.col("ts") > 4 * N.MICRO) & (F.col("activities") == 0)
    text = F.concat(_hours(F.col("ts")).cast("string"), F.lit("h worked without any activity"))
    details = F.struct(_hours(F.col("ts")).alias("timesheet_hours"), F.lit(0).alias("activities"))
    return F.when(fires, _record("missing_reports", F.lit("high"), text, details))


def day_rule_anomalies(
    ledger: DataFrame, employees: DataFrame, rules: list[Column]
) -> DataFrame:
    """Rows for every rule that fires; all rules are evaluated in one pass."""
    found = F.filter(F.array(*rules), lambda r: r.isNotNull())
    rows = ledger.select(*KEYS, F.explode(found).alias("r")).select(*KEYS, "r.*")
    return of_active(rows, employees).select(*ANOMALY_COLUMNS)


# ---------------------------------------------------------------- overlaps


def overlap_counts(timesheets: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Overlapping punches per employee and day: ordered pairs, so each pair counts twice.

    Two punches overlap when each starts before the other ends.  For a punch that is the
    number of starts before its end, less the number of ends up to its start, less
    itself; summed over the day this needs only running counts over instants.  Punches
    are first reduced per (employee, day, second), which bounds the running window by the
    seconds of a day and its longest shift, whatever the number of rows.
    """
    base = timesheets.where(within("work_date", date_from, date_to)).where(
        "start_ts is not null and end_ts is not null and end_ts >= start_ts"
    )
    point = F.col("start_ts") == F.col("end_ts")
    marks = F.array(
        F.struct(
            F.col("start_ts").alias("t"),
            F.when(point, 0).otherwise(1).alias("starts"),
            F.lit(0).alias("ends"),
            F.when(point, 1).otherwise(0).alias("points"),
        ),
        F.struct(
            F.col("end_ts").alias("t"),
            F.lit(0).alias("starts"),
            F.when(point, 0).otherwise(1).alias("ends"),
            F.lit(0).alias("points"),
        ),
    )
    instants = (
        base.select(*KEYS, F.explode(marks).alias("m"))
        .groupBy(*KEYS, F.col("m.t").alias("t"))
        .agg(
            F.sum("m.starts").alias("starts"),
            F.sum("m.ends").alias("ends"),
            F.sum("m.points").alias("points"),
        )
    )
    w = Window.partitionBy(*KEYS).orderBy("t")
    before = F.coalesce(
        F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    ended = F.sum("ends").over(w.rowsBetween(Window.unboundedPreceding, 0))
    swept = instants.withColumn("before", before).withColumn("ended", ended)
    pairs = F.sum(
        F.col("ends") * F.col("before")
        - F.col("starts") * (F.col("ended") + 1)
        + 2 * F.col("points") * (F.col("before") - F.col("ended"))
    )
    return swept.groupBy(*KEYS).agg(pairs.alias("overlaps")).where("overlaps > 0")


def overlaps(timesheets: DataFrame, employees: DataFrame, date_from=None, date_to=None) -> DataFrame:
    n = F.col("overlaps")
    rows = of_active(overlap_counts(timesheets, date_from, date_to), employees)
    return rows.select(
        *KEYS,
        F.lit("overlaps").alias("type"),
        F.lit("high").alias("severity"),
        F.concat(F.lit("overlapping punches: "), n.cast("string"), F.lit(" conflicts")).alias("description"),
        F.to_json(F.struct(n.alias("overlaps"))).alias("details"),
    )


# ---------------------------------------------------------------- travel


def travel_mismatches(
    timesheets: DataFrame,
    vehicle_log: DataFrame,
    clients: DataFrame,
    employees: DataFrame,
    date_from=None,
    date_to=None,
) -> DataFrame:
    """Worked at one client while the vehicle was booked for another, or for none.

    Both feeds are first reduced to the distinct clients of an (employee, day) with row
    counts; ``occurrences`` is the number of row pairs behind an output row, so nothing
    is lost and a crowded day does not multiply.
    """
    in_period = within("work_date", date_from, date_to)
    names = clients.select("client_id", "client_name")
    worked = (
        timesheets.where(in_period)
        .where(F.col("client_id").isNotNull())
        .groupBy(*KEYS, "client_id")
        .agg(F.count(F.lit(1)).alias("n_worked"))
    )
    worked = of_active(worked, employees).join(names, "client_id").withColumnRenamed(
        "client_name", "worked_client"
    )
    driven = (
        vehicle_log.where(in_period)
        .groupBy(*KEYS, F.col("client_id").alias("car_client_id"))
        .agg(F.count(F.lit(1)).alias("n_driven"))
    )
    car_names = clients.select(
        F.col("client_id").alias("car_client_id"), F.col("client_name").alias("car_client")
    )
    differs = F.col("car_client_id").isNull() | (F.col("car_client_id") != F.col("client_id"))
    return (
        worked.join(driven, KEYS, "left")
        .where(differs)
        .join(car_names, "car_client_id", "left")
        .select(
            *KEYS,
            "client_id",
            "worked_client",
            "car_client_id",
            "car_client",
            (F.col("n_worked") * F.coalesce("n_driven", F.lit(1))).alias("occurrences"),
        )
    )


def travel(
    timesheets: DataFrame,
    vehicle_log: DataFrame,
    clients: DataFrame,
    employees: DataFrame,
    date_from=None,
    date_to=None,
) -> DataFrame:
    rows = travel_mismatches(timesheets, vehicle_log, clients, employees, date_from, date_to)
    text = F.when(
        F.col("car_client").isNull(),
        F.concat(F.lit("work at "), "worked_client", F.lit(" without a recorded vehicle")),
    ).otherwise(
        F.concat(F.lit("vehicle used for "), "car_client", F.lit(" but work at "), "worked_client")
    )
    return rows.select(
        *KEYS,
        F.lit("travel_mismatch").alias("type"),
        F.lit("medium").alias("severity"),
        text.alias("description"),
        F.to_json(F.struct("worked_client", "car_client", "occurrences")).alias("details"),
    )


# ---------------------------------------------------------------- all together


def validate_all(
    employees: DataFrame,
    timesheets: DataFrame,
    activities: DataFrame,
    calendar: DataFrame,
    remote_sessions: DataFrame,
    vehicle_log: DataFrame,
    absences: DataFrame,
    clients: DataFrame,
    date_from=None,
    date_to=None,
    settings: Settings | None = None,
    faithful: bool = False,
) -> DataFrame:
    """All six validators over a period."""
    s = settings or Settings()
    ledger = day_ledger(
        timesheets, activities, calendar, remote_sessions, absences, date_from, date_to
    )
    rules = [hours_mismatch(s, faithful), orphan_sessions(), insufficient_hours(s), missing_reports()]
    return union_all(
        [
            day_rule_anomalies(ledger, employees, rules),
            overlaps(timesheets, employees, date_from, date_to),
            travel(timesheets, vehicle_log, clients, employees, date_from, date_to),
        ]
    )


def open_anomalies(anomalies: DataFrame, employee_id=None, date_from=None, date_to=None) -> DataFrame:
    """Unresolved anomalies, newest day first, most severe first."""
    return filtered(anomalies.where(~F.col("resolved")), employee_id, date_from, date_to).orderBy(
        F.desc("work_date"), F.desc(severity_rank(F.col("severity"))), "employee_id", "type", "description"
    )
