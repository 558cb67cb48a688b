"""The reference SQL of every query, for DuckDB."""

from __future__ import annotations

# Named building blocks.  A query lists the frames it needs; they are emitted as CTEs in
# this order, each with the frames it depends on.
FRAMES: dict[str, tuple[list[str], str]] = {
    "employees": ([], """
        select u.employee_id,
               upper(left(lower(c_mktsegment), 1)) || substr(lower(c_mktsegment), 2) as first_name,
               'Zz' || translate(u.employee_id::varchar, '0123456789', 'abcdefghij') || ' '
                 || upper(left(translate(lower(n_name), '_0123456789', 'xabcdefghij'), 1))
                 || substr(translate(lower(n_name), '_0123456789', 'xabcdefghij'), 2) as last_name,
               c_name as full_name,
               case when u.employee_id % 7 <> 0
                    then (80 + (u.employee_id % 3) * 60)::decimal(8,2) end as daily_cost,
               u.employee_id % 10 <> 0 as active
        from (select distinct user_id as employee_id from events) u
        left join customer on c_custkey = u.employee_id
        left join nation on n_nationkey = c_nationkey"""),
    "clients": ([], "select s_suppkey as client_id, s_name as client_name from supplier"),
    "vehicles": ([], """
        select distinct p_size::bigint as vehicle_id, 'Van ' || p_size::varchar as vehicle_name,
               0.35::decimal(5,2) as cost_km
        from part"""),
    "timesheets": ([], """
        select event_id as id, user_id as employee_id,
               case when event_id % 4 <> 0 then event_id % 10 end as client_id,
               ts::date as work_date, date_trunc('second', ts) as start_ts,
               date_trunc('second', ts)
                 + to_seconds(floor(least(value / 20.0::double, 12.0::double) * 3600.0::double)::bigint) as end_ts,
               (floor(least(value / 20.0::double, 12.0::double) * 100.0::double)::decimal(18,0)
                 * 0.01::decimal(3,2))::decimal(5,2) as hours
        from events where event_type = 'view'"""),
    "activities": ([], """
        select event_id as id, user_id as employee_id, event_id % 10 as client_id,
               case when regexp_extract(props, '([0-9]+)', 1)::int % 10 <> 0
                    then regexp_extract(props, '([0-9]+)', 1)::int end as ticket_id,
               date_trunc('second', ts) as start_ts,
               date_trunc('second', ts) + to_seconds(floor(value * 600.0::double)::bigint) as end_ts,
               (floor(greatest(value / 60.0::double, 0.01::double) * 100.0::double)::decimal(18,0)
                 * 0.01::decimal(3,2))::decimal(5,2) as duration_hours,
               case when event_id % 11 <> 0 then
                 case when event_id % 3 = 0 then 'Remote support: ' else 'On-site visit: ' end
                 || p_name || ', ' || p_type || ', ' || p_brand end as description,
               event_id % 5 <> 0 as billable
        from events
        left join part on p_partkey = event_id % (select count(*) from part)
        where event_type = 'click'"""),
    "calendar": ([], """
        select event_id as id, user_id as employee_id, date_trunc('second', ts) as start_ts,
               date_trunc('second', ts) + to_seconds(floor(value * 60.0::double)::bigint) as end_ts
        from events where event_type = 'signup'"""),
    "remote_sessions": ([], """
        select event_id as id, user_id as employee_id, date_trunc('second', ts) as start_ts
        from events where event_type = 'error'"""),
    "vehicle_log": ([], """
        select event_id as id, user_id as employee_id, event_id % 60 as vehicle_id,
               event_id % 10 as client_id, ts::date as work_date,
               date_trunc('second', ts) as pickup_ts,
               case when event_id % 5 <> 0 then
                 date_trunc('second', ts) + to_seconds(floor(value * 60.0::double)::bigint) end as return_ts,
               case when event_id % 9 <> 0 then floor(value)::int end as km
        from events where event_type = 'purchase'"""),
    "absences": ([], """
        select event_id as id, user_id as employee_id, ts::date as from_date,
               ts::date + (event_id % 3)::int as to_date,
               case event_id % 4 when 0 then 'pending' when 3 then 'rejected' else 'approved' end as state
        from events where event_type = 'signup'"""),
    # -------------------------------------------------------------- daily KPI
    "bounds": (["timesheets"], "select min(work_date) as lo, max(work_date) as hi from timesheets"),
    "spine": (["employees", "bounds"], """
        select employee_id, daily_cost as own_cost, unnest(generate_series(lo, hi, interval 1 day))::date as work_date
        from employees, bounds where active"""),
    "act_days": (["activities"], """
        select *, start_ts::date = end_ts::date as single_day,
               date_sub('minute', greatest(start_ts, work_date::timestamp),
                        least(end_ts, (work_date + 1)::timestamp)) as day_minutes,
               date_sub('minute', start_ts, end_ts) as total_minutes
        from (select *, unnest(generate_series(start_ts::date, end_ts::date, interval 1 day))::date as work_date
              from activities)"""),
    "k_act": (["act_days"], """
        select employee_id, work_date,
               sum(case when single_day then (duration_hours * 1000000)::bigint
                        else floor(day_minutes::double / 60.0::double * 1000000.0::double + 0.5::double)::bigint
                   end)::bigint as act,
               sum(case when not billable then null
                        when single_day then (duration_hours * 1000000)::bigint
                        when total_minutes = 0 then null
                        else floor(day_minutes::double * duration_hours::double / total_minutes::double
                                   * 1000000.0::double + 0.5::double)::bigint
                   end)::bigint as bill
        from act_days group by all"""),
    "k_ts": (["timesheets"], """
        select employee_id, work_date, (sum(hours) * 1000000)::bigint as ts,
               count(*)::bigint as punches
        from timesheets group by all"""),
    "k_on": (["timesheets", "clients"], """
        select employee_id, work_date, (sum(hours) * 1000000)::bigint as onsite
        from timesheets join clients using (client_id) group by all"""),
    "k_cal": (["calendar"], """
        select employee_id, work_date,
               sum(floor(date_sub('minute', greatest(start_ts, work_date::timestamp),
                                  least(end_ts, (work_date + 1)::timestamp))::double / 60.0::double
                         * 1000000.0::double + 0.5::double)::bigint)::bigint as cal
        from (select *, unnest(generate_series(start_ts::date, end_ts::date, interval 1 day))::date as work_date
              from calendar) group by all"""),
    "k_rem": (["remote_sessions"], """
        select employee_id, start_ts::date as work_date, count(*)::bigint as remote_sessions
        from remote_sessions group by all"""),
    "k_veh": (["vehicle_log"], """
        select employee_id, work_date, count(*)::bigint as uses,
               coalesce(sum(floor(date_sub('minute', pickup_ts, return_ts)::double / 60.0::double
                                  * 1000000.0::double + 0.5::double)::bigint), 0)::bigint as travel
        from vehicle_log group by all"""),
    "measures": (["spine", "k_ts", "k_on", "k_act", "k_cal", "k_rem", "k_veh"], """
        select s.employee_id, s.work_date, coalesce(own_cost, 80)::decimal(18,2) as daily_cost,
               coalesce(ts, 0) as ts, coalesce(act, 0) as act, coalesce(cal, 0) as cal,
               coalesce(bill, 0) as bill, coalesce(onsite, 0) as onsite,
               coalesce(travel, 0) as travel, coalesce(remote_sessions, 0) as remote_sessions,
               coalesce(uses, 0) as uses,
               least(150.0::double, coalesce(bill, 0)::double /
                 (case when greatest(coalesce(ts, 0), coalesce(act, 0)) > 0
                       then greatest(coalesce(ts, 0), coalesce(act, 0)) else 8000000 end)::double
                 * 100.0::double) as raw_eff
        from spine s
        left join k_ts using (employee_id, work_date)
        left join k_on using (employee_id, work_date)
        left join k_act using (employee_id, work_date)
        left join k_cal using (employee_id, work_date)
        left join k_rem using (employee_id, work_date)
        left join k_veh using (employee_id, work_date)"""),
    "kpi": (["measures"], """
        select employee_id, work_date,
               (ts::decimal(20,0) * 0.000001)::decimal(18,2) as timesheet_hours,
               (act::decimal(20,0) * 0.000001)::decimal(18,2) as activity_hours,
               (cal::decimal(20,0) * 0.000001)::decimal(18,2) as calendar_hours,
               (bill::decimal(20,0) * 0.000001)::decimal(18,2) as billable_hours,
               (floor(raw_eff * 1000000.0::double + 0.5::double)::decimal(20,0) * 0.000001)::decimal(18,2) as efficiency_rate,
               daily_cost,
               (bill::decimal(18,0) * 0.000001 * 50.00)::decimal(18,2) as revenue,
               (bill::decimal(18,0) * 0.000001 * 50.00 - daily_cost)::decimal(18,2) as profit_loss,
               remote_sessions,
               (onsite::decimal(20,0) * 0.000001)::decimal(18,2) as onsite_hours,
               (travel::decimal(20,0) * 0.000001)::decimal(18,2) as travel_hours,
               (uses > 0)::int as vehicle_usage
        from measures"""),
    # -------------------------------------------------------------- names and master data
    "stored_people": ([], """
        select c_custkey as employee_id,
               case c_custkey % 12 when 0 then 'Punto' when 1 then 'Admin' when 2 then 'Al'
                 when 3 then 'u' || c_custkey::varchar || '@example.com' when 4 then repeat('Lungo', 11)
                 when 5 then c_custkey::varchar when 6 then 'Anna/Bruno' when 7 then 'Carla, Dino' when 8 then 'Elio'
                 else upper(left(lower(c_mktsegment), 1)) || substr(lower(c_mktsegment), 2) end as first_name,
               case c_custkey % 12 when 0 then '' when 2 then '' when 8 then 'Ferri; Gatti - Lodi'
                 else 'Zz' || translate(c_custkey::varchar, '0123456789', 'abcdefghij') end as last_name
        from customer"""),
    "linked_people": (["employees"], """
        select employee_id + 1000000 as employee_id, first_name,
               case when employee_id % 5 = 0 then last_name || ' jr' else last_name end as last_name,
               case when employee_id % 3 <> 0 then employee_id end as master_id
        from employees"""),
    "raw_names": (["employees"], """
        select event_id, ts,
               case event_id % 10 when 0 then first_name || ' ' || last_name
                 when 1 then upper(first_name || ' ' || last_name)
                 when 2 then last_name || ', ' || first_name
                 when 3 then first_name || ' ' || left(last_name, 4)
                 when 4 then 'Info / ' || first_name || ' ' || last_name
                 when 5 then last_name when 6 then 'Van 12'
                 when 7 then 'u' || employee_id::varchar || '@example.com'
                 when 8 then 'Nuovo Tecnico' || translate(employee_id::varchar, '0123456789', 'abcdefghij')
                 else first_name || ' ' || last_name || ' e Altro Collega' end as name
        from events join employees on employee_id = user_id"""),
    "aliases": (["employees"], """
        select alias_first, alias_last, min(employee_id) as employee_id from (
          select employee_id, first_name, last_name, unnest(list_filter([first_name,
                   case first_name when 'Building' then 'Bill' when 'Machinery' then 'Mac' end], lambda x: x is not null)) as alias_first,
                 ls as lasts
          from (select *, list_filter([last_name, case when strlen(last_name) > 4 then left(last_name, 4) end],
                                      lambda x: x is not null) as ls from employees)) a
        cross join lateral (select unnest(a.lasts) as alias_last)
        where alias_first <> first_name or alias_last <> last_name
        group by alias_first, alias_last"""),
    "raw_clients": ([], """
        select o_orderkey,
               case o_orderkey % 5 when 0 then 'Supplier#' || lpad(o_custkey::varchar, 9, '0')
                 when 1 then 'supplier#' || lpad(o_custkey::varchar, 9, '0') || ' '
                 when 2 then 'Supplier ' || lpad(o_custkey::varchar, 9, '0') || ' Italia'
                 when 3 then 'Azienda ' || translate(o_custkey::varchar, '0123456789', 'abcdefghij')
                 else '' end as client_name
        from orders"""),
    "queue": ([], """
        select o_orderkey as id, 'client ' || o_custkey::varchar as client_name,
               case when o_orderkey % 3 <> 0 then o_custkey % 120 end as suggested_id,
               case when o_orderkey % 4 = 0 then o_custkey % 100 end as assigned_id,
               case when o_orderkey % 3 <> 0 then 0.7::double else 0.0::double end as confidence,
               case o_orderstatus when 'P' then 'pending' when 'F' then 'assigned' else 'rejected' end as status,
               o_orderdate as created_at
        from orders"""),
    "master_words": (["employees"], """
        select employee_id, list_distinct(list_filter(regexp_split_to_array(lower(first_name || ' ' || last_name), '[^a-z0-9]+'),
                                                      lambda w: length(w) >= 1)) as words
        from employees where active"""),
    "word_weights": (["master_words"], """
        select word, count(*) as df from (select unnest(words) as word from master_words) group by word"""),
    "candidates": (["raw_names"], """
        select name, pos, candidate from (
          select name, unnest(parts) as candidate, generate_subscripts(parts, 1) - 1 as pos from (
            select name, case when len(p) > 1 then list_append(p, trim(name)) else [trim(name)] end as parts from (
              select name,
                coalesce(
                  case when len(sl) > 1 then sl end, case when len(cm) > 1 then cm end, case when len(an) > 1 then an end, [name]) as p
              from (select name,
                           list_filter(list_transform(string_split(name, '/'), lambda x: trim(x)), lambda x: x <> '') as sl,
                           list_filter(list_transform(string_split(name, ','), lambda x: trim(x)), lambda x: x <> '') as cm,
                           list_filter(list_transform(string_split(name, ' e '), lambda x: trim(x)), lambda x: x <> '') as an
                    from (select distinct trim(name) as t, name from raw_names where trim(name) <> '')))))"""),
    "cand_words": (["candidates", "word_weights", "master_words"], """
        select candidate, word, floor(ln(1.0::double + (select count(*) from master_words)::double
                                         / coalesce(df, 1)::double) * 1000000.0::double + 0.5::double)::bigint as wt
        from (select candidate, unnest(list_distinct(list_filter(regexp_split_to_array(lower(candidate), '[^a-z0-9]+'),
                                                                 lambda w: length(w) >= 1))) as word
              from (select distinct candidate from candidates))
        left join word_weights using (word)"""),
    "fuzzy": (["cand_words", "master_words"], """
        select candidate, employee_id, s::double / total::double as score from (
          select *, row_number() over (partition by candidate order by s desc, employee_id) as rk from (
            select c.candidate, m.employee_id, sum(c.wt)::bigint as s, any_value(total) as total
            from (select *, sum(wt) over (partition by candidate) as total from cand_words) c
            join (select employee_id, unnest(words) as word from master_words) m using (word)
            group by c.candidate, m.employee_id)
          where s > 0.5::double * total) where rk = 1"""),
    "resolved": (["candidates", "employees", "aliases", "fuzzy", "linked_people", "vehicles"], """
        with c as (select distinct candidate from candidates),
        answers as (
          select candidate, 1 as rank, 'master' as method, min(employee_id) as employee_id
          from c join employees on lower(first_name || ' ' || last_name) = lower(candidate) group by candidate
          union all
          select candidate, 2, 'alias', min(employee_id)
          from c join aliases on trim(lower(alias_first || ' ' || alias_last)) = trim(lower(candidate)) group by candidate
          union all
          select candidate, 3, 'fuzzy', employee_id from fuzzy
          union all
          select candidate, 4, 'stored', min(employee_id) from c join linked_people
            on lower(first_name || ' ' || last_name) = lower(candidate)
              or lower(last_name || ', ' || first_name) = lower(candidate) group by candidate
          union all
          select candidate, 5, 'new', -1 from c
          where strlen(candidate) between 2 and 50 and not contains(candidate, '@')
            and not regexp_matches(candidate, '^[0-9]+$') and regexp_matches(candidate, '^[a-zA-ZÀ-ÿ ''-]')
            and not regexp_matches(lower(candidate), '^(pc|nb|server|host|www|http|ftp)')
            and not regexp_matches(lower(candidate), '[.](com|it|org|net|gov)$')
            and lower(candidate) not in ('punto', 'fiesta', 'peugeot', 'auto', 'veicolo', 'info', 'system', 'admin', 'test',
              'user', 'guest', 'true', 'false', 'null', 'aurora', 'reminder', 'meeting', 'riunione', 'supporto', 'backup',
              'cliente', 'fornitore', 'ufficio', 'sede', 'filiale')
            and lower(candidate) not in (select lower(vehicle_name) from vehicles)),
        best as (select * from answers qualify row_number() over (partition by candidate order by rank) = 1),
        chosen as (
          select c.name, c.candidate, b.method, b.employee_id
          from candidates c join best b using (candidate)
          qualify row_number() over (partition by c.name order by c.pos) = 1)
        select n.name, candidate, coalesce(method, 'rejected') as method,
               case when employee_id >= 0 then employee_id end as employee_id
        from (select distinct name from raw_names where trim(name) <> '') n left join chosen using (name)"""),
    # -------------------------------------------------------------- second imports
    "activities_re": (["activities"], """
        select * replace (2 * id as id) from activities
        union all
        select 2 * id + 1, employee_id, client_id, ticket_id,
               start_ts + to_minutes(case id % 4 when 0 then 0 when 3 then 4 else 2 end),
               end_ts + to_minutes(case id % 4 when 0 then 0 when 3 then 4 else 2 end),
               (duration_hours + case when id % 4 = 1 then 0.01 else 0.00 end)::decimal(5,2),
               case when id % 4 = 1 then regexp_replace(description, ' [^ ]+$', '') else description end,
               billable
        from activities"""),
    "timesheets_re": (["timesheets"], """
        select * replace (2 * id as id) from timesheets
        union all
        select 2 * id + 1, employee_id, client_id, work_date, start_ts,
               end_ts + to_minutes(case when id % 3 = 2 then 5 else 0 end), hours
        from timesheets"""),
    # Row by row in id order, per employee and ticket: an exact match with a kept row, else the nearest
    # kept row that scores enough; a merge hands its longer description to the kept row.
    "fold_rows": (["activities_re"], """
        select id, employee_id, ticket_id, epoch(start_ts)::bigint as s, duration_hours::double as dur,
               lower(trim(description)) as txt, strlen(trim(description))::bigint as len,
               row_number() over (partition by employee_id, ticket_id order by id) as rk
        from activities_re where ticket_id is not null and ticket_id <> 0"""),
    "fold": (["fold_rows"], """
        with recursive steps as (
          select employee_id, ticket_id, rk, id, [{'id': id, 's': s, 'dur': dur, 'txt': txt, 'len': len}] as kept,
                 null::struct(gap bigint, id bigint, score double) as best, null::bigint as twin
          from fold_rows where rk = 1
          union all
          select employee_id, ticket_id, rk, id,
                 case when twin is not null then kept
                      when best is null then list_append(kept, {'id': id, 's': s, 'dur': dur, 'txt': txt, 'len': len})
                      when best.score > 0.9::double and coalesce(len, 0) > 0 then
                        list_transform(kept, lambda k: case when k.id = best.id and len > coalesce(k.len, 0)
                          then {'id': k.id, 's': k.s, 'dur': k.dur, 'txt': txt, 'len': len} else k end)
                      else kept end,
                 case when twin is null then best end, twin
          from (
            select r.*, g.kept,
                   list_min(list_transform(list_filter(g.kept, lambda k: k.s = r.s and k.dur = r.dur), lambda k: k.id)) as twin,
                   list_sort(list_filter(list_transform(list_filter(g.kept, lambda k: abs(r.s - k.s) <= 180),
                     lambda k: {'gap': abs(r.s - k.s) // 60, 'id': k.id, 'score':
                       least(1.0::double,
                         (case when r.dur > 0 and k.dur > 0
                               then greatest(0.0::double, 1.0::double - abs(r.dur - k.dur) / greatest(r.dur, k.dur) * 10.0::double)
                               else 0.0::double end) * 0.3::double
                         + (case when r.len > 0 and k.len > 0
                                 then greatest(0.0::double, 1.0::double - levenshtein(r.txt, k.txt)::double / greatest(r.len, k.len)::double)
                                 else 0.0::double end) * 0.4::double
                         + 1.0::double * 0.3::double)}),
                     lambda h: h.score >= 0.85::double))[1] as best
            from steps g join fold_rows r
              on r.employee_id = g.employee_id and r.ticket_id = g.ticket_id and r.rk = g.rk + 1))
        select id, best, twin from steps"""),
    "decisions": (["activities_re", "fold"], """
        select a.id,
               md5(concat_ws('|', a.employee_id::varchar, strftime(a.start_ts, '%Y-%m-%d %H:%M:%S'),
                             a.duration_hours::varchar, coalesce(a.ticket_id::varchar, ''))) as activity_hash,
               case when x.twin is not null then 'mark' when f.best.score > 0.9::double then 'merge'
                    when f.best is not null then 'mark' else 'insert' end as action,
               case when x.twin is not null then 'exact' when f.best is not null then 'near' end as duplicate_type,
               coalesce(x.twin, f.best.id) as original_id,
               case when x.twin is not null then 1.0::double else f.best.score end as confidence,
               case when x.twin is null then f.best.gap end as minutes_apart
        from activities_re a left join fold f using (id)
        left join (
          select id, twin from fold where twin is not null
          union all
          select id, f from (select id, min(id) over (partition by employee_id, start_ts, duration_hours, ticket_id) as f
                             from activities_re where ticket_id is null or ticket_id = 0) where id <> f) x using (id)"""),
    # -------------------------------------------------------------- validators
    "abs_days": (["absences"], """
        select employee_id, work_date, count(*)::bigint as absences
        from (select employee_id, unnest(generate_series(from_date, to_date, interval 1 day))::date as work_date
              from absences where state = 'approved') group by all"""),
    "act_start": (["activities"], """
        select employee_id, start_ts::date as work_date, (sum(duration_hours) * 1000000)::bigint as act,
               count(*)::bigint as activities,
               count(*) filter (where lower(description) like '%remoto%' or lower(description) like '%teamviewer%'
                                   or lower(description) like '%remote%')::bigint as remote_activities
        from activities group by all"""),
    "cal_start": (["calendar"], """
        select employee_id, start_ts::date as work_date,
               sum(floor(date_sub('minute', start_ts, end_ts)::double / 60.0::double * 1000000.0::double + 0.5::double)::bigint)::bigint as cal
        from calendar group by all"""),
    "v_hours": (["employees", "k_ts", "act_start", "cal_start"], """
        select *, greatest(abs(ts - act), abs(ts - cal)) as gap from (
          select employee_id, work_date, punches, ts, coalesce(act, 0) as act, coalesce(cal, 0) as cal
          from k_ts left join act_start using (employee_id, work_date)
          left join cal_start using (employee_id, work_date)
          where employee_id in (select employee_id from employees where active))"""),
    "v_hours_faithful": (["v_hours"], """
        select *, greatest(abs(ts - act), abs(ts - cal)) as gap from (
          select employee_id, work_date, punches, ts, act * punches as act, cal * punches as cal from v_hours)"""),
    "v_overlaps": (["employees", "timesheets"], """
        select a.employee_id, a.work_date, count(*)::bigint as n_overlaps
        from timesheets a join timesheets b
          on a.employee_id = b.employee_id and a.work_date = b.work_date and a.id <> b.id
         and a.start_ts < b.end_ts and b.start_ts < a.end_ts
        where a.employee_id in (select employee_id from employees where active)
        group by all"""),
    "v_travel": (["employees", "timesheets", "vehicle_log", "clients"], """
        select t.employee_id, t.work_date, t.client_id, c.client_name as worked_client,
               v.client_id as car_client_id, c2.client_name as car_client, count(*)::bigint as occurrences
        from timesheets t join clients c on c.client_id = t.client_id
        left join vehicle_log v on v.employee_id = t.employee_id and v.work_date = t.work_date
        left join clients c2 on c2.client_id = v.client_id
        where t.employee_id in (select employee_id from employees where active)
          and (v.client_id is null or v.client_id <> t.client_id)
        group by all"""),
    "v_sessions": (["employees", "k_rem", "act_start"], """
        select r.employee_id, r.work_date, r.remote_sessions
        from k_rem r
        where r.employee_id in (select employee_id from employees where active)
          and not exists (select 1 from act_start a where a.employee_id = r.employee_id
                          and a.work_date = r.work_date and a.remote_activities > 0)"""),
    "v_short": (["employees", "k_ts", "absences"], """
        select t.employee_id, t.work_date, t.ts
        from k_ts t where t.ts < 7000000
          and t.employee_id in (select employee_id from employees where active)
          and not exists (select 1 from absences a where a.employee_id = t.employee_id and a.state = 'approved'
                          and a.from_date <= t.work_date and a.to_date >= t.work_date)"""),
    "v_reports": (["employees", "k_ts", "activities"], """
        select t.employee_id, t.work_date, t.ts
        from k_ts t where t.ts > 4000000
          and t.employee_id in (select employee_id from employees where active)
          and not exists (select 1 from activities a where a.employee_id = t.employee_id
                          and a.start_ts::date = t.work_date)"""),
    "anomalies_raw": (["v_hours", "v_overlaps", "v_travel", "v_sessions", "v_short", "v_reports"], """
        select employee_id, work_date, 'hours_mismatch' as type,
               case when gap > 3000000 then 'high' when gap > 2000000 then 'medium' else 'low' end as severity,
               'hours differ: timesheet ' || (ts::decimal(20,0) * 0.000001)::decimal(18,2)::varchar || 'h, activities '
                 || (act::decimal(20,0) * 0.000001)::decimal(18,2)::varchar || 'h, calendar '
                 || (cal::decimal(20,0) * 0.000001)::decimal(18,2)::varchar || 'h' as description,
               '{"timesheet_hours":' || (ts::decimal(20,0) * 0.000001)::decimal(18,2)::varchar
                 || ',"activity_hours":' || (act::decimal(20,0) * 0.000001)::decimal(18,2)::varchar
                 || ',"calendar_hours":' || (cal::decimal(20,0) * 0.000001)::decimal(18,2)::varchar
                 || ',"activity_gap":' || (abs(ts - act)::decimal(20,0) * 0.000001)::decimal(18,2)::varchar
                 || ',"calendar_gap":' || (abs(ts - cal)::decimal(20,0) * 0.000001)::decimal(18,2)::varchar || '}' as details
        from v_hours where gap > 1000000
        union all
        select employee_id, work_date, 'overlaps', 'high',
               'overlapping punches: ' || n_overlaps::varchar || ' conflicts', '{"overlaps":' || n_overlaps::varchar || '}'
        from v_overlaps
        union all
        select employee_id, work_date, 'travel_mismatch', 'medium',
               case when car_client is null then 'work at ' || worked_client || ' without a recorded vehicle'
                    else 'vehicle used for ' || car_client || ' but work at ' || worked_client end,
               '{"worked_client":"' || worked_client || '"'
                 || coalesce(',"car_client":"' || car_client || '"', '')
                 || ',"occurrences":' || occurrences::varchar || '}'
        from v_travel
        union all
        select employee_id, work_date, 'orphan_sessions', 'medium',
               remote_sessions::varchar || ' remote sessions without a matching activity',
               '{"remote_sessions":' || remote_sessions::varchar || ',"matching_activities":0}'
        from v_sessions
        union all
        select employee_id, work_date, 'insufficient_hours', 'high',
               'only ' || (ts::decimal(20,0) * 0.000001)::decimal(18,2)::varchar || 'h of 7h and no approved absence',
               '{"timesheet_hours":' || (ts::decimal(20,0) * 0.000001)::decimal(18,2)::varchar || ',"minimum_hours":7}'
        from v_short
        union all
        select employee_id, work_date, 'missing_reports', 'high',
               (ts::decimal(20,0) * 0.000001)::decimal(18,2)::varchar || 'h worked without any activity',
               '{"timesheet_hours":' || (ts::decimal(20,0) * 0.000001)::decimal(18,2)::varchar || ',"activities":0}'
        from v_reports"""),
    "anomalies": (["anomalies_raw"], """
        select *, (employee_id + day(work_date)) % 3 = 0 as resolved from anomalies_raw"""),
}


def _needed(names: list[str]) -> list[str]:
    seen: set[str] = set()

    def visit(name: str) -> None:
        if name in seen:
            return
        seen.add(name)
        for dep in FRAMES[name][0]:
            visit(dep)

    for n in names:
        visit(n)
    return [n for n in FRAMES if n in seen]


def with_frames(names: list[str], body: str) -> str:
    ctes = [f"{n} as materialized ({FRAMES[n][1]})" for n in _needed(names)]
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body


# Logical column type -> (Spark type, DuckDB type) at the edge of a query.
EDGE_TYPES = {
    "long": ("bigint", "BIGINT"),
    "num": ("double", "DOUBLE"),
    "text": ("string", "VARCHAR"),
    "bool": ("boolean", "BOOLEAN"),
}


def parse_columns(columns: str) -> list[tuple[str, str]]:
    out = []
    for item in columns.split():
        name, _, kind = item.partition(":")
        out.append((name, kind or "long"))
    return out


def oracle(columns: str, frames: list[str], body: str) -> str:
    """Full SQL: CTEs, the body, and the edge casts shared with the Spark side."""
    select = ", ".join(f"cast({n} as {EDGE_TYPES[k][1]}) as {n}" for n, k in parse_columns(columns))
    ctes = [f"{n} as materialized ({FRAMES[n][1]})" for n in _needed(frames)]
    ctes.append(f"result as ({body})")
    return "with " + ",\n".join(ctes) + f"\nselect {select} from result"
