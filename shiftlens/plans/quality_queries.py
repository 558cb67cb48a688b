"""Queries over the data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shiftlens.functions.names import SYSTEM_NAMES, VEHICLE_NAMES, is_valid_person_name
from shiftlens.operators import dedup as D, groups as G, people as P, quality as Q
from shiftlens.plans.dedup_queries import _decisions
from shiftlens.plans.domain import Domain
from shiftlens.plans.kpi_queries import kpi_of
from shiftlens.plans.registry import Query
from shiftlens.plans.validation_queries import raw_anomalies

ISSUE_SQL = """
    select employee_id, first_name, last_name,
           case when lower(trim(first_name)) in ('punto', 'fiesta', 'peugeot') then 'VEICOLO'
                when lower(trim(first_name)) in ('info', 'system', 'admin', 'test', 'aurora') then 'SISTEMA'
                when trim(last_name) = '' and strlen(first_name) < 3 then 'NOME_CORTO'
                when contains(first_name, '@') or contains(last_name, '@') then 'EMAIL'
                when strlen(first_name) > 50 or strlen(last_name) > 50 then 'TROPPO_LUNGO'
                when regexp_matches(first_name, '^[0-9]+$') or regexp_matches(last_name, '^[0-9]+$') then 'SOLO_NUMERI'
                else 'VALIDO' end as issue
    from stored_people"""


def _children(d: Domain) -> dict[str, DataFrame]:
    return {
        "timesheets": d.timesheets,
        "activities": d.activities,
        "calendar": d.calendar,
        "remote_sessions": d.remote_sessions,
        "vehicle_log": d.vehicle_log,
        "absences": d.absences,
    }


def _bad_people(d: Domain) -> DataFrame:
    return Q.name_issues(d.stored_people)


def _resolved_by(d: Domain) -> DataFrame:
    return raw_anomalies(d).withColumn("resolved_by", F.expr("(employee_id + day(work_date)) % 40"))


def _flagged(d: Domain) -> DataFrame:
    return d.activities_reimported.select("id").join(
        _decisions(d).select("id", (F.col("action") != "insert").alias("is_duplicate")), "id"
    )


def _rejects(d: Domain) -> DataFrame:
    """Second import with some ends pulled before the start."""
    a = d.activities_reimported.withColumn(
        "end_ts", F.expr("case when id % 5 = 0 then timestampadd(HOUR, -200, end_ts) else end_ts end")
    ).withColumn("duration_hours", F.expr("case when id % 7 = 0 then duration_hours - 1 else duration_hours end"))
    return a


def _integrity(d: Domain) -> DataFrame:
    a = _rejects(d)
    groups = G.duplicate_groups(a, ["employee_id", "start_ts", "duration_hours", F.expr("left(coalesce(description, ''), 50) as t")])
    return Q.integrity_summary(
        [
            _bad_people(d).agg(F.lit("invalid_names").alias("check_name"), F.count(F.lit(1)).alias("issues")),
            groups.agg(F.lit("duplicate_groups").alias("check_name"), F.count(F.lit(1)).alias("issues")),
            Q.broken_rows(a, "broken_rows"),
            Q.as_check(Q.orphan_count(d.vehicle_log, d.vehicles, "vehicle_id", "vehicle_id", "vehicles"), "orphans"),
            Q.as_check(Q.orphan_count(a, d.employees, "employee_id", "employee_id", "employees"), "orphans"),
            Q.as_check(Q.orphan_count(d.timesheets, d.clients, "client_id", "client_id", "clients"), "orphans"),
        ]
    )


CHILDREN_SQL = " union all ".join(
    f"select '{t}' as table_name, employee_id from {t}"
    for t in ["timesheets", "activities", "calendar", "remote_sessions", "vehicle_log", "absences"]
)
CHILD_FRAMES = ["timesheets", "activities", "calendar", "remote_sessions", "vehicle_log", "absences"]
REJECT_SQL = """(select * replace (case when id % 5 = 0 then end_ts - to_hours(200) else end_ts end as end_ts,
                        case when id % 7 = 0 then duration_hours - 1 else duration_hours end as duration_hours)
                 from activities_re)"""

QUERIES = {
    "name_issues": Query(
        "employee_id first_name:text last_name:text issue:text",
        _bad_people,
        f"select * from ({ISSUE_SQL}) where issue <> 'VALIDO'",
        ["stored_people"],
    ),
    "name_patterns": Query(
        "pattern:text people",
        lambda d: Q.name_patterns(d.stored_people),
        """select case when contains(first_name, '/') or contains(last_name, '/') then 'SEPARATORE_SLASH'
                       when contains(first_name, ',') or contains(last_name, ',') then 'SEPARATORE_VIRGOLA'
                       when contains(first_name, ';') or contains(last_name, ';') then 'SEPARATORE_PUNTO_VIRGOLA'
                       when first_name = '' or last_name = '' then 'CAMPO_VUOTO'
                       when regexp_matches(first_name, '[0-9]') or regexp_matches(last_name, '[0-9]') then 'CONTIENE_NUMERI'
                       else 'NORMALE' end as pattern, count(*) as people
           from stored_people group by 1""",
        ["stored_people"],
    ),
    "separated_names": Query(
        "employee_id first_name:text last_name:text separator:text split:text",
        lambda d: Q.separated_names(d.stored_people),
        """select employee_id, first_name, last_name, separator,
                  concat_ws(' ', case when contains(first_name, separator) then 'first: [' || replace(first_name, separator, '] [') || ']' end,
                            case when contains(last_name, separator) then 'last: [' || replace(last_name, separator, '] [') || ']' end) as split
           from stored_people cross join (select unnest(['/', ',', ';', '-', '+', '&']) as separator)
           where contains(first_name, separator) or contains(last_name, separator)""",
        ["stored_people"],
    ),
    "reserved_names": Query(
        "employee_id first_name:text last_name:text",
        lambda d: Q.reserved_names(d.stored_people, VEHICLE_NAMES + SYSTEM_NAMES),
        """select * from stored_people where lower(trim(first_name)) in ('punto','fiesta','peugeot','info','system','admin','test','aurora')
              or lower(trim(last_name)) in ('punto','fiesta','peugeot','info','system','admin','test','aurora')""",
        ["stored_people"],
    ),
    "valid_person_names": Query(
        "employee_id valid:bool",
        lambda d: d.stored_people.select("employee_id", is_valid_person_name(F.col("first_name")).alias("valid")),
        """select employee_id, c_custkey_valid as valid from (
             select employee_id, not (first_name in ('Punto', 'Admin') or strlen(first_name) not between 2 and 50
               or contains(first_name, '@') or regexp_matches(first_name, '^[0-9]+$')) as c_custkey_valid from stored_people)""",
        ["stored_people"],
    ),
    "rejected_activities": Query(
        "id broken_rule:text",
        lambda d: Q.split_valid(_rejects(d), Q.activity_rejects(_rejects(d)))[1],
        f"""select id, case when end_ts < start_ts then 'end_before_start' else 'duration_not_positive' end as broken_rule
            from {REJECT_SQL} where end_ts < start_ts or duration_hours <= 0""",
        ["activities_re"],
    ),
    "accepted_activities": Query(
        "id",
        lambda d: Q.split_valid(_rejects(d), Q.activity_rejects(_rejects(d)))[0],
        f"select id from {REJECT_SQL} where not (end_ts < start_ts or duration_hours <= 0)",
        ["activities_re"],
    ),
    "accepted_timesheets": Query(
        "id",
        lambda d: Q.split_valid(d.timesheets, Q.timesheet_rejects(d.timesheets))[0],
        "select id from timesheets where end_ts >= start_ts and hours > 0",
        ["timesheets"],
    ),
    "orphan_vehicles": Query(
        "check_name:text orphans",
        lambda d: Q.orphan_count(d.vehicle_log, d.vehicles, "vehicle_id", "vehicle_id", "vehicle_log"),
        """select 'vehicle_log' as check_name, count(*) as orphans from vehicle_log l
           where not exists (select 1 from vehicles v where v.vehicle_id = l.vehicle_id)""",
        ["vehicle_log", "vehicles"],
    ),
    "orphan_employees_not_in": Query(
        "check_name:text orphans",
        lambda d: Q.orphans_not_in(d.activities, d.linked_people, "employee_id", "master_id", "activities"),
        """select 'activities' as check_name, count(*) as orphans from activities
           where employee_id not in (select master_id from linked_people)""",
        ["activities", "linked_people"],
    ),
    "rows_per_employee": Query(
        "employee_id activities timesheets kpi",
        lambda d: Q.per_parent_counts(
            d.employees, {"activities": d.activities, "timesheets": d.timesheets, "kpi": kpi_of(d)}
        ),
        """select employee_id, (select count(*) from activities a where a.employee_id = e.employee_id) as activities,
                  (select count(*) from timesheets t where t.employee_id = e.employee_id) as timesheets,
                  (select count(*) from kpi k where k.employee_id = e.employee_id) as kpi
           from employees e""",
        ["employees", "activities", "timesheets", "kpi"],
    ),
    "kpi_rows_per_employee": Query(
        "employee_id full_name:text kpi_rows",
        lambda d: Q.kpi_rows_per_employee(d.employees, kpi_of(d)),
        """select e.employee_id, e.full_name, count(k.work_date) as kpi_rows
           from employees e left join kpi k using (employee_id) group by all""",
        ["employees", "kpi"],
    ),
    "reference_counts": Query(
        "table_name:text employee_id reference_count",
        lambda d: Q.reference_counts(d.employees, _children(d)),
        f"select table_name, employee_id, count(*) as reference_count from ({CHILDREN_SQL}) group by all",
        ["employees", *CHILD_FRAMES],
    ),
    "dependency_counts": Query(
        "table_name:text dependent_rows",
        lambda d: Q.dependency_counts(_bad_people(d), _children(d), _resolved_by(d)),
        f"""with bad as (select employee_id from ({ISSUE_SQL}) where issue <> 'VALIDO')
            select t.table_name, count(c.employee_id) as dependent_rows
            from (select distinct table_name from ({CHILDREN_SQL})) t
            left join (select * from ({CHILDREN_SQL}) where employee_id in (select employee_id from bad)) c using (table_name)
            group by all
            union all
            select 'anomalies', count(*) from anomalies_raw
            where employee_id in (select employee_id from bad)
               or (employee_id + day(work_date)) % 40 in (select employee_id from bad)""",
        ["stored_people", *CHILD_FRAMES, "anomalies_raw"],
    ),
    "cascade_delete": Query(
        "table_name:text rows",
        lambda d: Q.table_inventory(
            Q.cascade_delete(_bad_people(d), {**_children(d), "anomalies": _resolved_by(d)}), set()
        ),
        f"""with bad as (select employee_id from ({ISSUE_SQL}) where issue <> 'VALIDO')
            select table_name, count(*) as rows from ({CHILDREN_SQL})
            where employee_id not in (select employee_id from bad) group by all
            union all
            select 'anomalies', count(*) from anomalies_raw
            where employee_id not in (select employee_id from bad)
              and (employee_id + day(work_date)) % 40 not in (select employee_id from bad)""",
        ["stored_people", *CHILD_FRAMES, "anomalies_raw"],
    ),
    "duplicate_rate": Query(
        "marked total rate:num passed:bool",
        lambda d: Q.duplicate_rate(_flagged(d)),
        """select count(*) filter (where action <> 'insert') as marked, count(*) as total,
                  count(*) filter (where action <> 'insert')::double / count(*)::double * 100.0::double as rate,
                  count(*) filter (where action <> 'insert')::double / count(*)::double * 100.0::double < 50 as passed
           from decisions""",
        ["decisions"],
    ),
    "link_rate": Query(
        "linked total rate:num passed:bool",
        lambda d: Q.link_rate(P.bulk_link(d.linked_people, d.employees, ["first_name", "last_name"])),
        """select linked, total, linked::double / total::double * 100.0::double as rate,
                  linked::double / total::double * 100.0::double >= 80 as passed
           from (select count(coalesce(p.master_id, m.employee_id)) as linked, count(*) as total
                 from linked_people p left join employees m
                   on lower(m.first_name) = lower(p.first_name) and lower(m.last_name) = lower(p.last_name))""",
        ["linked_people", "employees"],
    ),
    "import_histogram": Query(
        "import_date:text import_hour created note:text",
        lambda d: Q.import_histogram(d.raw_names, "ts"),
        """select ts::date as import_date, hour(ts) as import_hour, count(*) as created,
                  case when count(*) > 20 then 'massive' when count(*) > 10 then 'high' else '' end as note
           from raw_names group by 1, 2""",
        ["raw_names"],
    ),
    "active_inventory": Query(
        "dimension:text active total",
        lambda d: Q.active_inventory(
            {
                "employees": (d.employees, F.col("active")),
                "clients": (d.clients, F.expr("client_id % 8 <> 0")),
                "vehicles": (d.vehicles, F.lit(True)),
            }
        ),
        """select 'employees' as dimension, count(*) filter (where active) as active, count(*) as total from employees
           union all select 'clients', count(*) filter (where client_id % 8 <> 0), count(*) from clients
           union all select 'vehicles', count(*), count(*) from vehicles""",
        ["employees", "clients", "vehicles"],
    ),
    "queue_states": Query(
        "total pending assigned rejected",
        lambda d: Q.queue_states(d.queue),
        """select count(*) as total, count(*) filter (where status = 'pending') as pending,
                  count(*) filter (where status = 'assigned') as assigned,
                  count(*) filter (where status = 'rejected') as rejected from queue""",
        ["queue"],
    ),
    "table_inventory": Query(
        "table_name:text class:text rows",
        lambda d: Q.table_inventory(
            {"employees": d.employees, "clients": d.clients, **_children(d)}, {"employees", "clients"}
        ),
        f"""select table_name, 'legacy' as class, count(*) as rows from ({CHILDREN_SQL}) group by all
            union all select 'employees', 'master', count(*) from employees
            union all select 'clients', 'master', count(*) from clients""",
        ["employees", "clients", *CHILD_FRAMES],
    ),
    "migration_dry_run": Query(
        "entity:text distinct_names",
        lambda d: Q.migration_dry_run(
            {
                "people": (d.stored_people, ["first_name", "last_name"]),
                "clients": (d.raw_clients, ["client_name"]),
                "projects": (d.table("part"), ["p_name"]),
            }
        ),
        """select 'people' as entity, count(*) as distinct_names from (select distinct first_name, last_name from stored_people where first_name <> '')
           union all select 'clients', count(distinct client_name) from raw_clients where client_name <> ''
           union all select 'projects', count(distinct p_name) from part where p_name <> ''""",
        ["stored_people", "raw_clients"],
    ),
    "integrity_summary": Query(
        "check_name:text issues",
        _integrity,
        f"""with checks as (
              select 'invalid_names' as check_name, count(*) as issues from ({ISSUE_SQL}) where issue <> 'VALIDO'
              union all select 'duplicate_groups', count(*) from (
                select 1 from {REJECT_SQL} group by employee_id, start_ts, duration_hours, left(coalesce(description, ''), 50) having count(*) > 1)
              union all select 'broken_rows', count(*) from {REJECT_SQL} where end_ts < start_ts or duration_hours <= 0
              union all select 'vehicles', count(*) from vehicle_log where vehicle_id not in (select vehicle_id from vehicles)
              union all select 'employees', count(*) from activities_re where employee_id not in (select employee_id from employees)
              union all select 'clients', count(*) from timesheets where client_id is not null and client_id not in (select client_id from clients))
            select * from checks union all select 'total', sum(issues) from checks""",
        ["stored_people", "activities_re", "vehicle_log", "vehicles", "employees", "timesheets", "clients"],
    ),
    "activities_per_suspect_day": Query(
        "suspect_days",
        lambda d: D.suspect_days(d.activities, 1),
        "select count(*) as suspect_days from (select 1 from activities group by employee_id, start_ts::date having count(*) > 1)",
        ["activities"],
    ),
}
