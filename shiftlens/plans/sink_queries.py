"""Queries over upserts, configuration, JSON results and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shiftlens import settings as ST
from shiftlens.operators import reports as R
from shiftlens.plans.domain import Domain
from shiftlens.plans.kpi_queries import KPI_COLUMNS, kpi_of
from shiftlens.plans.registry import Query
from shiftlens.plans.validation_queries import raw_anomalies
from shiftlens.session import working_path
from shiftlens.sinks import json_output as J, upsert as U
from shiftlens.sources import logs as L


def _kpi_upsert(d: Domain) -> DataFrame:
    """Stored rows up to the 20th with no profit, recomputed from the 15th on."""
    kpi = kpi_of(d).select("employee_id", "work_date", "billable_hours", "profit_loss")
    stored = kpi.where("work_date <= date'2024-01-20'").withColumn("profit_loss", F.lit(0).cast("decimal(18,2)"))
    return U.upsert(stored, kpi.where("work_date >= date'2024-01-15'"), ["employee_id", "work_date"])


def _stored_anomalies(d: Domain) -> DataFrame:
    """Anomalies of all employees as an earlier run left them, those of every second one resolved."""
    old = U.one_per_anomaly_key(raw_anomalies(d)).where("type <> 'travel_mismatch'")
    done = "employee_id % 2 = 0"
    return old.selectExpr(
        "employee_id", "work_date", "type", "'low' as severity", "'old' as description", "cast(null as string) as details", "1L as findings",
        f"{done} as resolved", f"case when {done} then 'seen' end as note",
        f"case when {done} then 1L end as resolved_by",
        f"case when {done} then timestamp'2024-02-01 10:00:00' end as resolved_at",
    )


def _resolutions(d: Domain) -> DataFrame:
    return _stored_anomalies(d).where("type = 'overlaps'").selectExpr(
        "employee_id", "work_date", "type", "concat('checked ', type) as note", "employee_id as resolved_by",
        "timestamp'2024-02-02 08:00:00' as resolved_at",
    )


def _punches(d: Domain) -> DataFrame:
    """Second import refreshes hours only."""
    updates = d.timesheets_reimported.where("id % 2 = 1").selectExpr(
        "employee_id", "work_date", "start_ts", "client_id + 1 as client_id", "cast(hours + 1 as decimal(7,2)) as hours"
    )
    target = d.timesheets.where("id % 2 = 0").selectExpr(
        "employee_id", "work_date", "start_ts", "client_id", "cast(hours as decimal(7,2)) as hours"
    )
    return U.upsert_columns(target, updates, ["employee_id", "work_date", "start_ts"], ["hours"])


def _last_session(d: Domain) -> DataFrame:
    return U.last_per_key(
        d.remote_sessions.selectExpr("employee_id", "to_date(start_ts) as work_date", "start_ts", "id"),
        ["employee_id", "work_date"], ["start_ts", "id"],
    )


def _config(d: Domain) -> DataFrame:
    """A configuration table with one key per part brand and type."""
    return d.table("part").groupBy("p_brand", "p_type").agg(F.max("p_size").alias("s")).selectExpr(
        "concat(p_brand, '.', p_type) as key",
        "case s % 5 when 0 then cast(s as string) when 1 then concat(s, '.25') when 2 then cast(s % 2 as string) "
        "when 3 then concat('{\"size\": ', s, '}') else concat('size ', s) end as value",
        "case s % 5 when 0 then 'integer' when 1 then 'float' when 2 then 'boolean' when 3 then 'json' else 'string' end as type",
        "p_brand as category",
    )


def _log_lines(d: Domain) -> DataFrame:
    return d.table("events").selectExpr(
        "concat(event_type, '.log') as file_name",
        "concat('[', date_format(cast(ts as timestamp), 'yyyy-MM-dd HH:mm:ss'), '] [s', user_id, '] [', "
        "case event_id % 5 when 0 then 'ERROR' when 1 then 'WARNING' when 2 then 'DEBUG' else 'INFO' end, "
        "'] [Memory: 1.5MB] [Time: ', event_id, 's] ', "
        "case when event_id % 6 = 0 then '=== Avvio sessione import (ID: x)' else 'riga' end) as value",
    )


LOG_SQL = """(select event_type || '.log' as file_name, strftime(ts, '%Y-%m-%d %H:%M:%S') as logged_at, 's' || user_id::varchar as session_id,
       case event_id % 5 when 0 then 'ERROR' when 1 then 'WARNING' when 2 then 'DEBUG' else 'INFO' end as level,
       event_id::double as elapsed_s,
       case when event_id % 6 = 0 then '=== Avvio sessione import (ID: x)' else 'riga' end as message from events)"""

ONE_ANOMALY = """(select employee_id, work_date, type, first(severity order by rank, description) as severity,
         string_agg(description, '; ' order by rank, description) as description, count(*) as findings
  from (select *, case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end as rank from anomalies_raw)
  group by employee_id, work_date, type)"""

def _rebuilt_kpi(d: Domain) -> DataFrame:
    """A KPI table with other days in it, rebuilt whole and read back."""
    kpi = kpi_of(d).drop("alerts")
    path = working_path(d.spark, "rebuilt")
    U.rebuild_table(kpi.withColumn("work_date", F.date_add("work_date", 20)), path, "work_date")
    U.rebuild_table(kpi, path, "work_date")
    return d.spark.read.parquet(path)


def _restored_config(d: Domain) -> DataFrame:
    """A config backed up, changed and extended, and restored from the backup."""
    config = _config(d)
    path = working_path(d.spark, "backup")
    J.backup_config(config, path)
    changed = config.where("type <> 'json'").withColumn("value", F.lit("changed"))
    added = config.limit(0).unionByName(d.spark.range(1).selectExpr("'new' as key", "'1' as value", "'integer' as type", "'own' as category"))
    return J.restore_config(d.spark, path, J.set_config(config, changed.unionByName(added)))


QUERIES = {
    "rebuilt_daily_kpi": Query(KPI_COLUMNS, _rebuilt_kpi, "select * from kpi", ["kpi"]),
    "restored_config": Query(
        "key:text value:text type:text category:text",
        _restored_config,
        """select p_brand || '.' || p_type as key,
                  case max(p_size) % 5 when 0 then max(p_size)::varchar when 1 then max(p_size)::varchar || '.25'
                      when 2 then (max(p_size) % 2)::varchar when 3 then '{"size": ' || max(p_size)::varchar || '}'
                      else 'size ' || max(p_size)::varchar end as value,
                  case max(p_size) % 5 when 0 then 'integer' when 1 then 'float' when 2 then 'boolean' when 3 then 'json' else 'string' end as type,
                  p_brand as category
           from part group by p_brand, p_type
           union all select 'new', '1', 'integer', 'own'""",
    ),
    "upsert_daily_kpi": Query(
        "employee_id work_date:text billable_hours:num profit_loss:num",
        _kpi_upsert,
        """select employee_id, work_date, billable_hours,
                  case when work_date < date '2024-01-15' then 0 else profit_loss end as profit_loss from kpi""",
        ["kpi"],
    ),
    "upsert_anomalies": Query(
        "employee_id work_date:text type:text severity:text description:text findings resolved:bool note:text resolved_by resolved_at:text",
        lambda d: U.upsert_anomalies(_stored_anomalies(d), raw_anomalies(d)),
        f"""select employee_id, work_date, type, severity, description, findings,
                   type <> 'travel_mismatch' and employee_id % 2 = 0 as resolved,
                   case when type <> 'travel_mismatch' and employee_id % 2 = 0 then 'seen' end as note,
                   case when type <> 'travel_mismatch' and employee_id % 2 = 0 then 1 end as resolved_by,
                   case when type <> 'travel_mismatch' and employee_id % 2 = 0 then '2024-02-01 10:00:00' end as resolved_at
            from {ONE_ANOMALY}""",
        ["anomalies_raw"],
    ),
    "resolve_anomalies": Query(
        "employee_id work_date:text type:text resolved:bool note:text resolved_by resolved_at:text",
        lambda d: U.resolve_anomalies(_stored_anomalies(d), _resolutions(d)),
        f"""select employee_id, work_date, type, type = 'overlaps' or employee_id % 2 = 0 as resolved,
                   case when type = 'overlaps' then 'checked overlaps' when employee_id % 2 = 0 then 'seen' end as note,
                   case when type = 'overlaps' then employee_id when employee_id % 2 = 0 then 1 end as resolved_by,
                   case when type = 'overlaps' then '2024-02-02 08:00:00' when employee_id % 2 = 0 then '2024-02-01 10:00:00' end as resolved_at
            from {ONE_ANOMALY} where type <> 'travel_mismatch'""",
        ["anomalies_raw"],
    ),
    "refresh_timesheet_hours": Query(
        "employee_id work_date:text start_ts:text client_id hours:num",
        _punches,
        """select employee_id, work_date, start_ts,
                  case when id % 2 = 0 then client_id else client_id + 1 end as client_id, hours + 1 as hours
           from timesheets""",
        ["timesheets"],
    ),
    "last_session_per_day": Query(
        "employee_id work_date:text start_ts:text id",
        _last_session,
        """select employee_id, start_ts::date as work_date, start_ts, id from remote_sessions
           qualify row_number() over (partition by employee_id, start_ts::date order by start_ts desc, id desc) = 1""",
        ["remote_sessions"],
    ),
    "typed_config": Query(
        "key:text value:text as_integer as_float:num as_boolean:bool as_string:text",
        lambda d: ST.typed_config(_config(d)),
        """select key, value, case when t = 0 then value::bigint end as as_integer, case when t = 1 then value::double end as as_float,
                  case when t = 2 then value not in ('', '0') end as as_boolean, case when t = 4 then value end as as_string
           from (select p_brand || '.' || p_type as key, max(p_size) % 5 as t,
                        case max(p_size) % 5 when 0 then max(p_size)::varchar when 1 then max(p_size)::varchar || '.25'
                          when 2 then (max(p_size) % 2)::varchar when 3 then '{"size": ' || max(p_size)::varchar || '}'
                          else 'size ' || max(p_size)::varchar end as value
                 from part group by p_brand, p_type)""",
    ),
    "performance_json": Query(
        "json:text",
        lambda d: J.as_json(
            R.performance_series(kpi_of(d), "2024-01-31", 7).select("label", "profit_loss", "active_employees")
        ),
        """select '{"label":"' || strftime(work_date, '%d/%m') || '","profit_loss":' || sum(profit_loss)::varchar
                  || ',"active_employees":' || count(*)::varchar || '}' as json
           from kpi where work_date >= date '2024-01-24' group by work_date
           union all
           select '{"label":"' || strftime(day, '%d/%m') || '","profit_loss":0.00,"active_employees":0}'
           from generate_series(date '2024-01-24', date '2024-01-31', interval 1 day) g(day)
           where day::date not in (select work_date from kpi)""",
        ["kpi"],
    ),
    "alerts_json": Query(
        "json:text",
        lambda d: J.as_json(R.alert_counts(kpi_of(d))),
        """select '{"efficiency_warnings":' || a::varchar || ',"efficiency_critical":' || b::varchar || ',"profit_warnings":' || c::varchar
                  || ',"insufficient_hours":' || e::varchar || ',"total":' || (a + b + c + e)::varchar || '}' as json
           from (select count(*) filter (where efficiency_rate < 70) as a, count(*) filter (where efficiency_rate < 50) as b,
                        count(*) filter (where profit_loss < -20) as c, count(*) filter (where billable_hours < 7) as e from kpi)""",
        ["kpi"],
    ),
    "log_stats": Query(
        "file_name:text total_lines error_count warning_count info_count debug_count sessions",
        lambda d: L.log_stats(_log_lines(d)),
        f"""select file_name, count(*) as total_lines, count(*) filter (where level = 'ERROR') as error_count,
                   count(*) filter (where level = 'WARNING') as warning_count, count(*) filter (where level = 'INFO') as info_count,
                   count(*) filter (where level = 'DEBUG') as debug_count, count(*) filter (where message like '===%') as sessions
            from {LOG_SQL} group by file_name""",
    ),
    "recent_log_lines": Query(
        "file_name:text logged_at:text session_id:text level:text elapsed_s:num message:text",
        lambda d: L.recent_lines(_log_lines(d), 100),
        f"select * from {LOG_SQL} order by logged_at desc, session_id desc, elapsed_s desc limit 100",
    ),
    "log_sessions": Query(
        "file_name:text first_at:text last_at:text lines errors memory_mb:num longest_step_s total_s",
        lambda d: L.log_sessions(_log_lines(d), "20 minutes"),
        f"""with instants as (select file_name, logged_at::timestamp as tick, count(*) as lines, count(*) filter (level = 'ERROR') as errors
                 from {LOG_SQL} group by all),
             stepped as (select *, date_diff('second', lag(tick) over (partition by file_name order by tick), tick) as step from instants),
             islands as (select *, count(*) filter (step is null or step > 1200) over (partition by file_name order by tick) as island from stepped)
           select file_name, min(tick) as first_at, max(tick) as last_at, sum(lines) as lines, sum(errors) as errors, 1.5 as memory_mb,
               coalesce(max(case when step <= 1200 then step end), 0) as longest_step_s, coalesce(sum(case when step <= 1200 then step end), 0) as total_s
           from islands group by file_name, island""",
    ),
}
