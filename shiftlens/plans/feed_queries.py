"""Queries over the feed-normalisation jobs and the field parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shiftlens.functions import temporal as TM, text as TX
from shiftlens.plans.domain import Domain, feed_lines_sql
from shiftlens.plans.registry import Query
from shiftlens.session import working_path
from shiftlens.sources import feeds as FD, jobs as J, lines as LN, loading as LD



def _dims(d: Domain) -> J.Dimensions:
    return J.Dimensions(d.employees, d.clients, d.vehicles)


def _blank(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast("string") for n in names})


def timesheets_feed(d: Domain) -> J.FeedResult:
    f = d.feed("view").withColumnsRenamed({"amount": "hours", "code": "source_id", "duration": "pause"})
    f = _blank(
        f.drop("person").withColumn("client_address", F.concat(F.lit("Via "), "client_name")),
        "client_city", "client_province", "start_address", "start_city", "start_province", "end_address",
        "end_city", "end_province", "description",
    ).withColumns({"rounded_hours": F.col("hours"), "net_hours": F.col("hours")})
    return J.timesheets(f, _dims(d))


def absences_feed(d: Domain) -> J.FeedResult:
    f = d.feed("signup").drop("person").withColumnsRenamed({"surname_first": "person", "start": "from", "end": "to"})
    return J.absences(f.withColumns({"requested": F.col("from"), "note": F.col("code")}), _dims(d))


def activities_feed(d: Domain) -> J.FeedResult:
    f = d.feed("click").drop("duration").withColumnsRenamed({"amount": "duration", "code": "description"})
    return J.activities(_blank(f, "project_code"), _dims(d))


def calendar_feed(d: Domain) -> J.FeedResult:
    f = d.feed("signup").withColumnsRenamed({"code": "title", "ticket": "p"}).drop("priority").withColumnRenamed("p", "priority")
    return J.calendar(_blank(f, "note", "location"), _dims(d))


def projects_feed(d: Domain) -> J.FeedResult:
    f = d.feed("error").withColumnsRenamed({"person": "lead", "start": "created", "end": "due", "amount": "hours_budget"})
    return J.projects(f.withColumn("name", F.col("code")), _dims(d))


def vehicle_log_feed(d: Domain) -> J.FeedResult:
    f = d.feed("purchase").withColumnsRenamed({"start": "pickup", "end": "return"})
    return J.vehicle_log(f.withColumn("date", F.col("pickup")), _dims(d))


def remote_fields(d: Domain) -> DataFrame:
    f = d.feed("error").withColumnsRenamed({"amount": "rate", "code": "session_code"})
    return _blank(f, "client_email", "session_type", "group", "billing_mode", "description", "note", "classification")


def remote_sessions_feed(d: Domain) -> J.FeedResult:
    return J.remote_sessions(remote_fields(d), _dims(d))


def _feed_sql(kind: str) -> str:
    return f"""
      select *, coalesce(try_strptime(start, '%d/%m/%Y %H:%M:%S'), try_strptime(start, '%Y-%m-%d %H:%M:%S'), try_strptime(start, '%d/%m/%Y %H:%M')) as s,
             try_strptime("end", '%Y-%m-%d %H:%M') as e from (
      select event_id, event_id::varchar as code, r.name as person, last_name || ', ' || first_name as surname_first,
             case when event_id % 10 = 8 then 'Nuovo' else first_name end as first_name, last_name,
             nullif(trim(client_name), '') as client_name,
             case event_id % 3 when 0 then strftime(ts, '%-d/%-m/%Y %-H:%M:%S') when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S')
               else strftime(ts, '%d/%m/%Y %H:%M') end as start,
             case when event_id % 5 <> 0 then strftime(date_trunc('second', ev.ts) + to_seconds(floor(value * 60.0::double)::bigint), '%Y-%m-%d %H:%M') end as "end",
             (floor(value * 100) / 100)::decimal(18,6)::decimal(7,2) as amount,
             case event_id % 4 when 0 then event_id % 97 when 1 then event_id % 5 * 60 + event_id % 60
               when 2 then event_id % 200 else event_id % 3 * 60 + event_id % 60 end as minutes,
             case event_id % 4 when 1 then event_id % 5 * 60 + event_id % 60 else 0 end as clock_minutes,
             regexp_extract(props, '([0-9]+)', 1) as ticket,
             case event_id % 5 when 0 then 'ferie' when 1 then 'rol' when 2 then 'malattia' else 'permessi' end as type,
             case event_id % 4 when 0 then 'approved' when 1 then 'rejected' else 'pending' end as state,
             case event_id % 5 when 0 then 'high' when 2 then 'low' when 3 then 'critical' else 'medium' end as priority,
             'Van ' || (event_id % 60)::varchar as vehicle_name
      from events ev join employees on employee_id = user_id
      join (select event_id, name from raw_names) r using (event_id)
      left join raw_clients on o_orderkey = event_id where event_type = '{kind}')"""


VALID = """(lower({n}) not in ('punto', 'fiesta', 'peugeot', 'auto', 'veicolo', 'info', 'system', 'admin', 'test', 'user', 'guest',
   'true', 'false', 'null', 'aurora', 'reminder', 'meeting', 'riunione', 'supporto', 'backup', 'cliente', 'fornitore', 'ufficio',
   'sede', 'filiale') and strlen({n}) between 2 and 50 and not contains({n}, '@') and not regexp_matches({n}, '^[0-9]+$')
   and regexp_matches({n}, '^[a-zA-ZÀ-ÿ ''-]') and not regexp_matches(lower({n}), '^(pc|nb|server|host|www|http|ftp)')
   and not regexp_matches(lower({n}), '[.](com|it|org|net|gov)$'))"""


def _staff_sql(person: str, check: bool) -> str:
    valid = (
        f"{VALID.format(n='trim(name)')} and {VALID.format(n='given')} and (family = '' or {VALID.format(n='family')}) "
        "and lower(trim(name)) not in (select lower(vehicle_name) from vehicles)"
        if check
        else "true"
    )
    return f"""
      names as (select distinct {person} as name from feed where {person} is not null),
      known as (select name, coalesce(
          (select min(employee_id) from employees where contains(trim(n.name), ' ') and lower(first_name) = lower(split_part(trim(n.name), ' ', 1))
             and lower(last_name) = lower(substr(trim(n.name), strpos(trim(n.name), ' ') + 1))),
          (select min(employee_id) from employees where contains(n.name, ', ') and lower(first_name) = lower(split_part(n.name, ', ', 2))
             and lower(last_name) = lower(split_part(n.name, ', ', 1)))) as employee_id from names n),
      fresh as (select name, lower(given) || '|' || lower(family) as key from (
          select name, case when contains(trim(name), ', ') then split_part(trim(name), ', ', 2) else split_part(trim(name), ' ', 1) end as given,
                 case when contains(trim(name), ', ') then split_part(trim(name), ', ', 1)
                      when contains(trim(name), ' ') then substr(trim(name), strpos(trim(name), ' ') + 1) else '' end as family
          from known where employee_id is null) where {valid}),
      ids as (select key, (select max(employee_id) from employees) + row_number() over (order by left(md5(key), 3), key) as employee_id
              from (select distinct key from fresh)),
      staff as (select name, employee_id from known where employee_id is not null
                union all select name, ids.employee_id from fresh join ids using (key))"""


CLIENTS_SQL = """
      newc as (select k, (select max(client_id) from clients) + row_number() over (order by left(md5(k), 3), k) as client_id
               from (select distinct lower(client_name) as k from feed where client_name is not null)
               where k not in (select lower(client_name) from clients)),
      cmap as (select distinct f.client_name as cname, coalesce(c.client_id, n.client_id) as client_id
               from feed f left join clients c on lower(c.client_name) = lower(f.client_name)
               left join newc n on n.k = lower(f.client_name) where f.client_name is not null)"""

# Header lines, file names and field texts as they come in files, made from events and documents.
_HEADER = r"""case when event_id % 7 = 0 then '' when event_id % 11 = 0 then 'a,b;c' else concat_ws(
  case event_id % 4 when 0 then ',' when 1 then ';' when 2 then chr(9) else '|' end,
  event_type, concat('"x', case when event_id % 3 = 0 then ',' else '' end, '"'), 'value', 'note', cast(user_id as string)) end"""
_FILE = """case event_id % 6 when 0 then 'Attivita_1.csv' when 1 then 'TIMBRATURE.csv' when 2 then 'log_teamviewer.csv'
  when 3 then 'calendario 2.csv' else concat(event_type, '.csv') end"""
_HEAD = """case event_id % 4 when 0 then 'ID;Creato da;Durata' when 1 then 'Ora_Inizio,ora_fine' when 2 then 'Computer;x' else 'y' end"""
_FIELD = r"""case event_id % 4 when 0 then concat('  "', event_type, '  ', chr(9), cast(user_id as string), '" ')
  when 1 then concat('"', event_type) when 2 then concat(chr(10), event_type, chr(13), chr(10), ' x ') else '   ' end"""


def _duck(expression: str) -> str:
    return expression.replace("as string", "as varchar")


FRAMES = ["employees", "raw_names", "raw_clients", "clients", "vehicles"]


def _job(columns: str, run, kind: str, select: str, person: str = "person", check: bool = True, where: str = "") -> Query:
    sql = f"""with feed as materialized ({_feed_sql(kind)}), {_staff_sql(person, check)}, {CLIENTS_SQL}
      select {select} from feed join staff on staff.name = {person}
      left join cmap on cname = client_name where s is not null {where}"""
    return Query(columns, lambda d: run(d).rows, sql, FRAMES)


def _rejects(run, kind: str, person: str = "person") -> Query:
    sql = f"""with feed as materialized ({_feed_sql(kind)}), {_staff_sql(person, True)}
      select * from (
        select code, case when {person} not in (select name from staff) then 'unknown person'
                          when s is null then 'no readable start' when e is null then 'no readable end' end as reject_reason
        from feed) where reject_reason is not null"""
    return Query("code:text reject_reason:text", run, sql, FRAMES)


# Cells by parity of the quotes around them; a field's value is the first filled cell of its names.
PARSED_LINES = rf"""
    lines as materialized ({feed_lines_sql()}),
    heads as (select file, line as header from lines where position = -1),
    marked as (select *, list_reduce([',', ';', chr(9), '|'], lambda a, b:
            case when length(header) - length(replace(header, b, '')) > length(header) - length(replace(header, a, '')) then b else a end) as sep
        from heads),
    named as (select file, sep, list_transform(string_split(header, sep), lambda c: lower(trim(c, ' "'))) as keys from marked),
    cut as (select l.file, name, position, line, sep, keys,
            string_split(list_reduce(list_transform(string_split(line, '"'),
                lambda p, i: case when i % 2 = 1 then replace(p, sep, chr(1)) else p end), lambda a, b: a || '"' || b), chr(1)) as raw
        from lines l join named using (file) where position >= 0 and trim(line) <> ''),
    cells as (select *, len(raw) = len(keys) and len(string_split(line, '"')) % 2 = 1 as sound,
            list_transform(raw, lambda c: case when length(trim(c)) >= 2 and left(trim(c), 1) = '"' and right(trim(c), 1) = '"'
                then replace(substr(trim(c), 2, length(trim(c)) - 2), '""', '"') else c end) as cells
        from cut),
    cleaned as (select *, list_transform(cells, lambda c: trim(regexp_replace(trim(c, ' ' || chr(9)), '\s+', ' ', 'g'))) as c from cells)"""


def _line_field(name: str, key: str) -> str:
    return f"case when sound then nullif(c[nullif(list_position(keys, '{key}'), 0)], '') end as {name}"


def _parsed_lines(d: Domain) -> DataFrame:
    rows = LN.parse_lines(d.feed_lines, FD.FEEDS["activities"])
    return rows.withColumn("sound", F.col(FD.CORRUPT).isNull()).withColumnsRenamed({FD.CORRUPT: "line", "_file": "name"})


def _feed_layouts(d: Domain) -> DataFrame:
    found = LN.layouts(d.feed_lines, FD.FEEDS["activities"])
    places = {n: F.coalesce(F.get(f"places.{n}", F.lit(0)), F.lit(0)) for n in ("ticket", "person", "client_name", "duration", "description")}
    return found.select("file", "separator", "columns", *[p.alias(n) for n, p in places.items()])


def _folder(d: Domain) -> str:
    """Two feeds made of events as delimited files, each with a header line, in a folder of its own."""
    path = working_path(d.spark, "folder")
    e = d.table("events").where("event_type = 'click'")
    e.selectExpr(
        "cast(event_id as string) as `Id Ticket`", "date_format(cast(ts as timestamp), 'dd/MM/yyyy HH:mm') as `Iniziata il`",
        "concat('Azienda; \"', user_id, '\"') as Azienda", "concat(event_id % 9, ',5') as Durata", "concat('Anna ', user_id) as ` CREATO DA `",
    ).write.option("header", True).option("sep", ";").option("escape", '"').csv(f"{path}/attivita.csv")
    v = d.table("events").where("event_type = 'purchase'")
    v.selectExpr(
        "concat('Anna ', user_id) as Dipendente", "date_format(cast(ts as timestamp), 'dd/MM/yyyy') as Data", "concat('Van ', event_id % 60) as AUTO"
    ).write.option("header", True).csv(f"{path}/registro_auto.csv")
    return path


def _directory(d: Domain) -> DataFrame:
    found = FD.read_directory(d.spark, _folder(d))
    missing = sorted(n for n, frame in found.items() if frame is None)
    a, _ = FD.split_corrupt(found["activities"])
    v, _ = FD.split_corrupt(found["vehicle_log"])
    rows = a.select(F.lit("activities").alias("feed"), F.col("ticket").alias("code"), "person", F.col("start").alias("day"), F.col("client_name").alias("what"))
    rows = rows.unionByName(v.select(F.lit("vehicle_log").alias("feed"), F.lit(None).cast("string").alias("code"), "person", F.col("date").alias("day"), F.col("vehicle_name").alias("what")))
    return rows.withColumn("absent", F.lit(",".join(missing)))


def _profiles(d: Domain) -> DataFrame:
    found = FD.file_profiles(d.spark, f"{_folder(d)}/*.csv")
    folder = F.regexp_extract("file_path", "([a-z_]+)[.]csv/", 1)
    return found.groupBy(folder.alias("feed"), "separator", "columns").agg(
        (F.sum("total_rows") - F.count(F.lit(1))).alias("rows"), F.bool_and(F.size("preview") == F.least(F.lit(5), F.col("total_rows") - 1)).alias("previewed")
    )


def _counted_load(d: Domain) -> DataFrame:
    """The sessions loaded onto those of every third event, stored before; those of odd events come
    twice, and every 17th has a broken line beside it."""
    fields = remote_fields(d).withColumn(FD.CORRUPT, F.lit(None).cast("string"))
    code = F.col("session_code").cast("bigint")
    raw = fields.unionByName(fields.where(code % 2 == 1)).unionByName(fields.where(code % 17 == 0).withColumn(FD.CORRUPT, F.lit("x")))
    before = remote_sessions_feed(d).rows.where(code % 3 == 0)
    return LD.counts_frame("remote_sessions", LD.load_feed("remote_sessions", raw, _dims(d), working_path(d.spark, "load"), before))


QUERIES = {
    "feed_layouts": Query(
        "file:text separator:text columns ticket person client_name duration description",
        _feed_layouts,
        f"""with {PARSED_LINES.strip()}
            select file, sep as separator, len(keys) as columns, {", ".join(f"coalesce(list_position(keys, '{k}'), 0) as {n}" for n, k in
                [("ticket", "id ticket"), ("person", "creato da"), ("client_name", "azienda"), ("duration", "durata"), ("description", "descrizione")])}
            from named""",
    ),
    "directory_of_feeds": Query(
        "feed:text code:text person:text day:text what:text absent:text",
        _directory,
        """select 'activities' as feed, event_id::varchar as code, 'Anna ' || user_id as person, strftime(ts, '%d/%m/%Y %H:%M') as day,
               'Azienda; "' || user_id || '"' as what, 'absences,calendar,projects,remote_sessions,timesheets' as absent
           from events where event_type = 'click'
           union all
           select 'vehicle_log', null, 'Anna ' || user_id, strftime(ts, '%d/%m/%Y'), 'Van ' || (event_id % 60), 'absences,calendar,projects,remote_sessions,timesheets'
           from events where event_type = 'purchase'""",
    ),
    "feed_profiles": Query(
        "feed:text separator:text columns rows previewed:bool",
        _profiles,
        """select 'attivita' as feed, ';' as separator, 5 as columns, count(*) as rows, true as previewed from events where event_type = 'click'
           union all select 'registro_auto', ',', 3, count(*), true from events where event_type = 'purchase'""",
    ),
    "counted_load": Query(
        "feed:text outcome:text rows",
        _counted_load,
        f"""with feed as materialized ({_feed_sql("error")}), {_staff_sql("person", True)},
               f as (select code::bigint as code, coalesce(s is not null and e is not null and person in (select name from staff), false) as sound from feed)
            select 'remote_sessions' as feed, unnest(['processed', 'corrupt', 'rejected', 'inserted', 'updated', 'duplicates']) as outcome,
                unnest([count(*) + count(*) filter (code % 2 = 1) + count(*) filter (code % 17 = 0), count(*) filter (code % 17 = 0),
                    count(*) filter (not sound) + count(*) filter (not sound and code % 2 = 1), count(*) filter (sound and code % 3 <> 0),
                    count(*) filter (sound and code % 3 = 0), count(*) filter (sound and code % 2 = 1)]) as rows
            from f""",
        FRAMES,
    ),
    "parsed_feed_lines": Query(
        "file:text name:text position sound:bool ticket:text person:text client_name:text duration:text description:text project_code:text line:text",
        _parsed_lines,
        f"""with {PARSED_LINES.strip()}
            select file, name, position, sound, {_line_field("ticket", "id ticket")}, {_line_field("person", "creato da")},
                {_line_field("client_name", "azienda")}, {_line_field("duration", "durata")}, {_line_field("description", "descrizione")},
                null as project_code, case when not sound then line end as line
            from cleaned""",
    ),
    "load_timesheets": _job(
        "employee_id client_id work_date:text start_ts:text end_ts:text hours:num pause_minutes source_id:text",
        timesheets_feed,
        "view",
        "employee_id, client_id, s::date as work_date, s as start_ts, e as end_ts, amount as hours, clock_minutes as pause_minutes, code as source_id",
        person="(first_name || ' ' || last_name)",
        check=False,
    ),
    "load_absences": _job(
        "employee_id type:text start_ts:text end_ts:text state:text note:text",
        absences_feed,
        "signup",
        "employee_id, type, s as start_ts, e as end_ts, state, code as note",
        person="surname_first",
        check=False,
        where="and e is not null",
    ),
    "load_activities": _job(
        "employee_id client_id ticket_id:text start_ts:text end_ts:text duration_hours:num description:text billable:bool",
        activities_feed,
        "click",
        "employee_id, client_id, nullif(ticket, '0') as ticket_id, s as start_ts, e as end_ts, amount as duration_hours, code as description, true as billable",
        where="and e is not null",
    ),
    "rejected_activities_of_feed": _rejects(
        lambda d: activities_feed(d).rejects.withColumnRenamed("description", "code"), "click"
    ),
    "load_calendar": _job(
        "employee_id title:text start_ts:text end_ts:text priority",
        calendar_feed,
        "signup",
        "employee_id, code as title, s as start_ts, e as end_ts, coalesce(nullif(ticket, '0'), '5') as priority",
        where="and e is not null",
    ),
    "load_projects": Query(
        "code:text state:text priority:text client_id lead_id started_at:text due_date:text hours_budget:num",
        lambda d: projects_feed(d).rows,
        f"""with feed as materialized ({_feed_sql('error')}), {_staff_sql('person', True)}, {CLIENTS_SQL}
            select code, 'active' as state, priority, client_id, employee_id as lead_id, s as started_at,
                   null as due_date, amount as hours_budget
            from feed left join staff on staff.name = person left join cmap on cname = client_name""",
        FRAMES,
    ),
    "load_vehicle_log": _job(
        "employee_id vehicle_id client_id work_date:text pickup_ts:text return_ts:text",
        vehicle_log_feed,
        "purchase",
        """employee_id, coalesce((select min(vehicle_id) from vehicles v where v.vehicle_name = feed.vehicle_name),
             (select max(vehicle_id) from vehicles) + (select count(*) from (select distinct lower(vehicle_name) as k from feed
                where vehicle_name not in (select vehicle_name from vehicles)) x
                where (left(md5(x.k), 3), x.k) <= (left(md5(lower(feed.vehicle_name)), 3), lower(feed.vehicle_name)))) as vehicle_id,
           client_id, case when event_id % 3 = 0 then null else s::date end as work_date, s as pickup_ts, e as return_ts""",
    ),
    "load_remote_sessions": _job(
        "employee_id client_name:text session_code:text session_type:text start_ts:text end_ts:text duration_minutes rate:num billing_mode:text",
        remote_sessions_feed,
        "error",
        """employee_id, client_name, code as session_code, 'Controllo remoto' as session_type, s as start_ts, e as end_ts,
           minutes as duration_minutes, amount as rate, 'Fattura' as billing_mode""",
        where="and e is not null",
    ),
    "header_separators": Query(
        "event_id separator:text",
        lambda d: d.table("events").select("event_id", FD.separator_of(F.expr(_HEADER)).alias("separator")),
        f"""select event_id, case when h = '' then ';'
              when c >= greatest(s, t, p) then ',' when s >= greatest(t, p) then ';' when t >= p then chr(9) else '|' end as separator
            from (select event_id, h, len(h) - len(replace(h, ',', '')) as c, len(h) - len(replace(h, ';', '')) as s,
                         len(h) - len(replace(h, chr(9), '')) as t, len(h) - len(replace(h, '|', '')) as p
                  from (select event_id, {_duck(_HEADER)} as h from events))""",
    ),
    "feed_types": Query(
        "event_id feed:text",
        lambda d: d.table("events").select("event_id", FD.feed_type_of(F.expr(_FILE), F.expr(_HEAD)).alias("feed")),
        """select event_id, case event_id % 6 when 0 then 'activities' when 1 then 'timesheets' when 2 then 'remote_sessions'
             when 3 then 'calendar' else case event_id % 4 when 1 then 'timesheets' when 2 then 'remote_sessions'
             else 'activities' end end as feed from events""",
    ),
    "cleaned_fields": Query(
        "event_id field:text",
        lambda d: d.table("events").select("event_id", TX.clean_value(F.expr(_FIELD)).alias("field")),
        """select event_id, case event_id % 4 when 0 then event_type || ' ' || user_id::varchar when 1 then '"' || event_type
             when 2 then event_type || ' x' else '' end as field from events""",
    ),
    "repaired_encoding": Query(
        "doc_id utf8:text cp1252:text",
        lambda d: d.table("documents").select(
            "doc_id",
            F.sha2(TX.repair_encoding(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")), 256).alias("utf8"),
            TX.repair_encoding(F.concat("source", F.lit(" \u00e9\u0080"))).alias("cp1252"),
        ),
        "select doc_id, sha256(text) as utf8, source || ' é€' as cp1252 from documents",
    ),
    "parsed_fields": Query(
        "code:text day:text clock:text amount:num minutes",
        lambda d: d.feed("click").select(
            "code",
            TM.parse_date(F.col("start")).alias("day"),
            TM.parse_time(F.col("start")).alias("clock"),
            TX.parse_decimal(F.col("amount")).alias("amount"),
            TX.parse_duration_minutes(F.col("duration")).alias("minutes"),
        ),
        f"""select code, case when event_id % 3 = 0 then null else s::date end as day,
                   case when event_id % 3 = 2 then strftime(s, '%H:%M:%S') end as clock, amount, minutes
            from ({_feed_sql('click')})""",
        FRAMES,
    ),
}
