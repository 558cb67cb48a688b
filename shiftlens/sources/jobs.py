"""Feed-normalisation jobs: fields of a feed -> typed rows with resolved ids.

Each job returns its rows, the rejected rows with a reason, and the dimension rows it
needs to exist.  Names are resolved once per distinct name and joined back; names that
fill a large part of a feed are answered on the map side (see ``attach_group``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.functions import names as NM, temporal as TM, text as TX
from shiftlens.functions.text import match_key
from shiftlens.operators import people as P
from shiftlens.operators.common import union_all
from shiftlens.operators.groups import attach_group
from shiftlens.session import cut_lineage

REASON = "reject_reason"


@dataclass
class FeedResult:
    """``rows`` to upsert, ``rejects`` with their reason, ``created`` dimension rows by
    dimension name, ``keys`` of the upsert and the columns a second load refreshes."""

    rows: DataFrame
    rejects: DataFrame
    keys: list[str]
    refresh: list[str]
    created: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Dimensions:
    employees: DataFrame
    clients: DataFrame
    vehicles: DataFrame
    projects: DataFrame | None = None


# ---------------------------------------------------------------- attaching ids


def attach_by_name(rows: DataFrame, name: str, resolved: DataFrame, spread: str) -> DataFrame:
    """Join a name map onto the rows of a feed, whatever share of them one name has.

    Rows without a name find nothing; they are dealt out by the hash of column ``spread``
    instead of meeting in one task.  A name that fills much of the feed, known or not, crowds
    the row side of the join only, which adaptive execution splits.
    """
    nowhere = F.concat(F.lit("\u0000"), F.xxhash64(spread).cast("string"))
    keyed = rows.withColumn("_name", F.coalesce(F.col(name).cast("string"), nowhere))
    known = resolved.where(F.col(name).isNotNull()).withColumn("_name", F.col(name).cast("string")).drop(name)
    return attach_group(keyed, ["_name"], known).drop("_name")


def staff_map(
    names: DataFrame, people: DataFrame, vehicles: DataFrame, name: str = "person", check: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(name -> employee_id, people to create).

    Known people are found by their parts.  Unknown names become new people when whole name
    and parts are valid and no vehicle is called so; with ``check`` off, always.

    The distinct names are cut from their lineage: several lookups use them, and the name
    rules would otherwise be pushed below the distinct and run on every row of the feed.
    """
    distinct = cut_lineage(names.where(F.col(name).isNotNull()).select(name).distinct())
    looked = P.lookup_by_parts(distinct, people, name)
    unknown = looked.where("employee_id is null").select(name)
    given, family = NM.split_full_name(F.col(name))
    if check:
        unknown = P.valid_people_names(unknown, vehicles, name).where(
            NM.is_valid_person_name(given) & NM.is_valid_person_name(family, allow_empty=True)
        )
    parts = unknown.select(name, given.alias("first_name"), family.alias("last_name")).withColumn(
        "_key", F.concat_ws("|", match_key(F.col("first_name")), match_key(F.col("last_name")))
    )
    per_person = parts.groupBy("_key").agg(F.min(F.struct("first_name", "last_name")).alias("_p"))
    highest = people.agg(F.max("employee_id")).scalar()
    created = P.assign_ids(per_person, "_key", highest, "employee_id")
    fresh = parts.join(created.select("_key", "employee_id"), "_key").select(name, "employee_id")
    known = looked.where("employee_id is not null").select(name, F.col("employee_id").cast("bigint"))
    return known.unionByName(fresh), created.select("employee_id", "_p.first_name", "_p.last_name")


def _with_staff(
    feed: DataFrame, dims: Dimensions, name: str, salt: str, check: bool = True
) -> tuple[DataFrame, DataFrame]:
    mapped, created = staff_map(feed, dims.employees, dims.vehicles, name, check)
    return attach_by_name(feed, name, mapped, salt), created


def _with_clients(
    rows: DataFrame, feed: DataFrame, dims: Dimensions, salt: str
) -> tuple[DataFrame, DataFrame]:
    mapped, created = P.get_or_create(
        feed.where("client_name is not null"), dims.clients, "client_name", "client_id", "client_name"
    )
    return attach_by_name(rows, "client_name", mapped.drop("created"), salt), created


def _tag(feed: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    reason = F.lit(None).cast("string")
    for broken, label in reversed(rules):
        reason = F.when(broken, F.lit(label)).otherwise(reason)
    return feed.withColumn(REASON, reason)


def _split(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = tagged.where(F.col(REASON).isNull()).drop(REASON)
    return good, tagged.where(F.col(REASON).isNotNull())


def _hours(column: str) -> Column:
    return TX.parse_decimal(F.col(column)).cast("decimal(18,6)").try_cast("decimal(7,2)")


NO_PERSON = "unknown person"
NO_START = "no readable start"
NO_END = "no readable end"
OUT_OF_RANGE = "number out of range"


def _unreadable(column: str) -> Column:
    return TM.parse_datetime(F.col(column)).isNull()


def _too_large(*columns: str) -> Column:
    """A number is there, but the stored type cannot hold it."""
    out = F.lit(False)
    for c in columns:
        out = out | (TX.parse_decimal(F.col(c)).isNotNull() & _hours(c).isNull())
    return out


# ---------------------------------------------------------------- the jobs


def timesheets(feed: DataFrame, dims: Dimensions) -> FeedResult:
    """Punches.  People are created as they come; clients with their address."""
    named = feed.withColumn(
        "person", F.nullif(F.concat_ws(" ", "first_name", "last_name"), F.lit(""))
    )
    staffed, people = _with_staff(named, dims, "person", "start", check=False)
    joined, clients = _with_clients(staffed, named, dims, "start")
    address = named.where("client_name is not null").groupBy(match_key(F.col("client_name")).alias("_k")).agg(
        F.min(F.struct("client_address", "client_city", "client_province")).alias("_a")
    )
    clients = clients.join(address, match_key(F.col("client_name")) == F.col("_k"), "left").select(
        "client_id", "client_name", "_a.client_address", "_a.client_city", "_a.client_province"
    )
    tagged = _tag(
        joined,
        (F.col("employee_id").isNull(), NO_PERSON),
        (_unreadable("start"), NO_START),
        (_too_large("hours", "rounded_hours", "net_hours"), OUT_OF_RANGE),
    )
    good, bad = _split(tagged)
    rows = good.select(
        "employee_id",
        "client_id",
        F.to_date(TM.parse_datetime(F.col("start"))).alias("work_date"),
        TM.parse_datetime(F.col("start")).alias("start_ts"),
        TM.parse_datetime(F.col("end")).alias("end_ts"),
        _hours("hours").alias("hours"),
        _hours("rounded_hours").alias("rounded_hours"),
        _hours("net_hours").alias("net_hours"),
        TX.parse_clock_minutes(F.col("pause")).alias("pause_minutes"),
        "start_address", "start_city", "start_province", "end_address", "end_city", "end_province",
        "description",
        "source_id",
    )
    return FeedResult(
        rows, bad, ["employee_id", "work_date", "start_ts", "end_ts"],
        ["hours", "rounded_hours", "net_hours"], {"employees": people, "clients": clients},
    )


def absences(feed: DataFrame, dims: Dimensions) -> FeedResult:
    """Absence requests; the person is written ``Surname, Name`` and created when unknown."""
    joined, people = _with_staff(feed, dims, "person", "from", check=False)
    tagged = _tag(
        joined,
        (F.col("employee_id").isNull(), NO_PERSON),
        (_unreadable("from"), NO_START),
        (_unreadable("to"), NO_END),
    )
    good, bad = _split(tagged)
    start, end = TM.parse_datetime(F.col("from")), TM.parse_datetime(F.col("to"))
    rows = good.select(
        "employee_id",
        TX.absence_type(F.col("type")).alias("type"),
        TM.parse_datetime(F.col("requested")).alias("requested_at"),
        start.alias("start_ts"),
        end.alias("end_ts"),
        F.to_date(start).alias("from_date"),
        F.to_date(end).alias("to_date"),
        TX.absence_state(F.col("state")).alias("state"),
        "note",
    )
    return FeedResult(
        rows, bad, ["employee_id", "type", "start_ts", "end_ts"], ["state", "note"], {"employees": people}
    )


def activities(feed: DataFrame, dims: Dimensions) -> FeedResult:
    """Activities.  Always billable; the project is looked up by code and made when new.
    De-duplicate the rows with ``operators.dedup`` before they are stored."""
    staffed, people = _with_staff(feed, dims, "person", "start")
    joined, clients = _with_clients(staffed, feed, dims, "start")
    created = {"employees": people, "clients": clients}
    if dims.projects is not None:
        codes = feed.where("project_code is not null")
        mapped, _ = P.get_or_create(codes, dims.projects, "project_code", "project_id", "code")
        joined = attach_by_name(joined, "project_code", mapped.drop("created"), "start")
        created["projects"] = P.new_projects(codes, dims.projects)
    else:
        joined = joined.withColumn("project_id", F.lit(None).cast("bigint"))
    tagged = _tag(
        joined,
        (F.col("employee_id").isNull(), NO_PERSON),
        (_unreadable("start"), NO_START),
        (_unreadable("end"), NO_END),
        (_too_large("duration"), OUT_OF_RANGE),
    )
    good, bad = _split(tagged)
    rows = good.select(
        "employee_id",
        "client_id",
        "project_id",
        TX.zero_as_missing(F.col("ticket")).alias("ticket_id"),
        TM.parse_datetime(F.col("start")).alias("start_ts"),
        TM.parse_datetime(F.col("end")).alias("end_ts"),
        _hours("duration").alias("duration_hours"),
        "description",
        "project_code",
        F.col("person").alias("created_by"),
        F.lit(True).alias("billable"),
    )
    return FeedResult(
        rows, bad, ["employee_id", "start_ts", "end_ts", "duration_hours"],
        ["client_id", "project_id", "ticket_id", "description", "project_code", "created_by", "billable"],
        created,
    )


def calendar(feed: DataFrame, dims: Dimensions) -> FeedResult:
    """Appointments.  Without an attendee, or with a vehicle for one, a row is rejected."""
    cars = dims.vehicles.select(match_key(F.col("vehicle_name")).alias("_v")).distinct()
    vehicles = (
        feed.select("person").where("person is not null").distinct()
        .join(cars, match_key(F.col("person")) == F.col("_v"), "left_semi")
        .withColumn("is_vehicle", F.lit(True))
    )
    staffed, people = _with_staff(feed, dims, "person", "start")
    joined = attach_by_name(staffed, "person", vehicles, "start")
    tagged = _tag(
        joined,
        (F.col("person").isNull(), "no attendee"),
        (F.coalesce("is_vehicle", F.lit(False)), "attendee is a vehicle"),
        (F.col("employee_id").isNull(), NO_PERSON),
        (_unreadable("start"), NO_START),
        (_unreadable("end"), NO_END),
    )
    good, bad = _split(tagged)
    priority = TX.zero_as_missing(F.col("priority")).try_cast("int")
    rows = good.select(
        "employee_id",
        F.coalesce("title", F.lit("")).alias("title"),
        TM.parse_datetime(F.col("start")).alias("start_ts"),
        TM.parse_datetime(F.col("end")).alias("end_ts"),
        "location",
        "note",
        F.coalesce(priority, F.lit(5)).alias("priority"),
        F.substring(F.coalesce("title", F.lit("")), 1, 100).alias("title_key"),
    )
    return FeedResult(
        rows, bad, ["employee_id", "start_ts", "title_key"], ["title", "location"], {"employees": people}
    )


def projects(feed: DataFrame, dims: Dimensions) -> FeedResult:
    """Projects; the lead and the client are looked up, the client is made when new."""
    staffed, people = _with_staff(feed, dims, "lead", "code")
    joined, clients = _with_clients(staffed, feed, dims, "code")
    tagged = _tag(joined, (F.col("code").isNull(), "no code"), (_too_large("hours_budget"), OUT_OF_RANGE))
    good, bad = _split(tagged)
    rows = good.select(
        "code",
        "name",
        TX.project_state(F.col("state")).alias("state"),
        TX.priority(F.col("priority")).alias("priority"),
        "client_id",
        F.col("employee_id").alias("lead_id"),
        TM.parse_datetime(F.col("created")).alias("started_at"),
        TM.parse_date(F.col("due")).alias("due_date"),
        F.when(F.col("hours_budget").isNotNull(), _hours("hours_budget")).alias("hours_budget"),
    )
    return FeedResult(
        rows, bad, ["code"], ["name", "state", "priority"], {"employees": people, "clients": clients}
    )


def vehicle_log(feed: DataFrame, dims: Dimensions) -> FeedResult:
    """Vehicle use; the return may be open."""
    staffed, people = _with_staff(feed, dims, "person", "pickup")
    mapped, vehicles = P.get_or_create(
        feed.where("vehicle_name is not null"), dims.vehicles, "vehicle_name", "vehicle_id", "vehicle_name"
    )
    driven = attach_by_name(staffed, "vehicle_name", mapped.drop("created"), "pickup")
    joined, clients = _with_clients(driven, feed, dims, "pickup")
    good, bad = _split(_tag(joined, (F.col("employee_id").isNull(), NO_PERSON)))
    rows = good.select(
        "employee_id",
        "vehicle_id",
        "client_id",
        TM.parse_date(F.col("date")).alias("work_date"),
        TM.parse_datetime(F.col("pickup")).alias("pickup_ts"),
        TM.parse_datetime(F.col("return")).alias("return_ts"),
    )
    return FeedResult(
        rows, bad, ["employee_id", "vehicle_id", "work_date", "pickup_ts"], ["return_ts"],
        {"employees": people, "vehicles": vehicles, "clients": clients},
    )


def remote_sessions(feed: DataFrame, dims: Dimensions) -> FeedResult:
    """Remote-support sessions of both layouts."""
    joined, people = _with_staff(feed, dims, "person", "start")
    tagged = _tag(
        joined,
        (F.col("person").isNull(), "no person"),
        (F.col("employee_id").isNull(), NO_PERSON),
        (_unreadable("start"), NO_START),
        (_unreadable("end"), NO_END),
        (_too_large("rate"), OUT_OF_RANGE),
    )
    good, bad = _split(tagged)
    rows = good.select(
        "employee_id",
        "client_name",
        "client_email",
        "session_code",
        F.coalesce("session_type", F.lit("Controllo remoto")).alias("session_type"),
        F.col("group").alias("group_name"),
        TM.parse_datetime(F.col("start")).alias("start_ts"),
        TM.parse_datetime(F.col("end")).alias("end_ts"),
        TX.parse_duration_minutes(F.col("duration")).alias("duration_minutes"),
        _hours("rate").alias("rate"),
        F.coalesce("billing_mode", F.lit("Fattura")).alias("billing_mode"),
        "description",
        "note",
        "classification",
        F.lit(True).alias("billable"),
    )
    return FeedResult(
        rows, bad, ["employee_id", "session_code", "start_ts"], ["duration_minutes"], {"employees": people}
    )


JOBS = {
    "timesheets": timesheets,
    "absences": absences,
    "activities": activities,
    "calendar": calendar,
    "projects": projects,
    "vehicle_log": vehicle_log,
    "remote_sessions": remote_sessions,
}


def import_counts(
    feed: str, raw: DataFrame, result: FeedResult, stored: DataFrame | None = None
) -> DataFrame:
    """Rows per outcome of one load: processed, inserted, updated, duplicates, skipped."""
    keys = result.keys
    per_key = result.rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if stored is None:
        tagged = per_key.withColumn("old", F.lit(False))
    else:
        known = stored.select(*[F.col(k).alias(f"_s_{k}") for k in keys]).distinct().withColumn("_old", F.lit(True))
        on = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]
        tagged = per_key.join(known, on, "left").withColumn("old", F.coalesce("_old", F.lit(False)))
    kept = tagged.agg(
        F.count(F.when(~F.col("old"), 1)).alias("inserted"),
        F.count(F.when(F.col("old"), 1)).alias("updated"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )

    def long(df: DataFrame, label: str) -> DataFrame:
        return df.agg(F.lit(feed).alias("feed"), F.lit(label).alias("outcome"), F.count(F.lit(1)).alias("rows"))

    corrupt = raw.where(F.col("_corrupt_record").isNotNull()) if "_corrupt_record" in raw.columns else raw.limit(0)
    return union_all(
        [
            long(raw, "processed"),
            kept.select(F.lit(feed).alias("feed"), F.explode(F.create_map(
                F.lit("inserted"), "inserted", F.lit("updated"), "updated", F.lit("duplicates"), "duplicates",
            )).alias("outcome", "rows")),
            long(corrupt, "corrupt"),
            long(result.rejects, "rejected"),
        ]
    )
