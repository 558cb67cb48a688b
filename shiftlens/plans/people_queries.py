"""Queries over name resolution and master data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shiftlens.functions import names as NM, text as TX
from shiftlens.operators import people as P
from shiftlens.plans.domain import Domain
from shiftlens.plans.registry import Query


def _master_name():
    return F.concat_ws(" ", "first_name", "last_name")


def _fuzzy(d: Domain) -> DataFrame:
    """Every spelling of the feeds against the active employees."""
    split = d.raw_names.select(F.explode(_with_whole()).alias("candidate"))
    return P.fuzzy_match(split, d.employees.where("active"), "candidate", "employee_id", _master_name())


def _with_whole():
    parts = NM.split_people(F.trim("name"))
    return F.when(F.size(parts) > 1, F.array_append(parts, F.trim("name"))).otherwise(parts)


def resolved(d: Domain) -> DataFrame:
    return P.resolve_people(d.raw_names, d.employees, d.aliases, d.linked_people, d.vehicles)


def _events_resolved(d: Domain) -> DataFrame:
    """The resolution of every event row: the map joined back."""
    return d.raw_names.join(resolved(d), "name").groupBy("method").agg(
        F.count(F.lit(1)).alias("events"), F.count("employee_id").alias("with_employee")
    )


def _clients_map(d: Domain) -> DataFrame:
    return P.get_or_create(d.raw_clients, d.clients, "client_name", "client_id", "client_name")[0]


def _clients_new(d: Domain) -> DataFrame:
    return P.get_or_create(d.raw_clients, d.clients, "client_name", "client_id", "client_name")[1]


def _projects(d: Domain) -> DataFrame:
    parts = d.table("part")
    codes = parts.selectExpr("concat('P-', p_name) as project_code")
    known = parts.groupBy("p_brand").agg(F.min("p_partkey").alias("project_id"), F.min("p_name").alias("n")).selectExpr(
        "project_id", "concat('p-', n) as code"
    )
    return P.new_projects(codes, known)


def _link(d: Domain, which: int) -> DataFrame:
    return P.link_or_create(resolved(d), d.employees, d.linked_people)[which]


def _consolidated(d: Domain) -> DataFrame:
    a = d.stored_people.withColumnRenamed("employee_id", "id").withColumn("email", F.lit("x@example.com"))
    b = d.employees.select(F.col("employee_id").alias("id"), "first_name", "last_name", "daily_cost")
    c = d.linked_people.select(F.col("employee_id").alias("id"), "first_name", "last_name")
    return P.consolidate([("legacy", a), ("master", b), ("linked", c)], ["first_name", "last_name"])


def _pending(d: Domain) -> DataFrame:
    return d.queue.selectExpr(
        "concat('Azienda ', translate(cast(id as string), '0123456789', 'abcdefghij')) as client_name", "status"
    )


def _expected(d: Domain) -> DataFrame:
    """Every stored customer name is expected among the employees."""
    return d.table("customer").selectExpr(
        "initcap(lower(c_mktsegment)) as first_name",
        "concat('Zz', translate(cast(c_custkey as string), '0123456789', 'abcdefghij')) as last_name",
    )


LINK_HITS = """(select name, employee_id as master_id from resolved where employee_id is not null
                and employee_id not in (select master_id from linked_people where master_id is not null))"""
KEY = "trim(lower(client_name))"

QUERIES = {
    "generated_aliases": Query(
        "alias_first:text alias_last:text employee_id", lambda d: d.aliases, "select * from aliases", ["aliases"]
    ),
    "split_people": Query(
        "event_id parts size",
        lambda d: d.raw_names.select(
            "event_id",
            F.size(NM.split_people(F.col("name"))).alias("parts"),
            F.length(F.array_join(NM.split_people(F.col("name")), "|")).alias("size"),
        ),
        """select event_id, len(p) as parts, length(array_to_string(p, '|')) as size from (
             select event_id, coalesce(
               case when contains(name, '/') then list_transform(string_split(name, '/'), lambda x: trim(x)) end,
               case when contains(name, ',') then list_transform(string_split(name, ','), lambda x: trim(x)) end,
               case when contains(name, ' e ') then list_transform(string_split(name, ' e '), lambda x: trim(x)) end, [name]) as p
             from raw_names)""",
        ["raw_names"],
    ),
    "lookup_by_parts": Query(
        "name:text employee_id",
        lambda d: P.lookup_by_parts(d.raw_names, d.linked_people),
        """select distinct n.name, coalesce(
             (select min(employee_id) from linked_people p where lower(p.first_name || ' ' || p.last_name) = lower(n.name)),
             (select min(employee_id) from linked_people p where lower(p.last_name || ', ' || p.first_name) = lower(n.name))) as employee_id
           from (select distinct name from raw_names) n""",
        ["raw_names", "linked_people"],
    ),
    "lookup_full_name": Query(
        "name:text employee_id",
        lambda d: P.lookup_full_name(d.raw_names, d.employees),
        """select n.name, min(e.employee_id) as employee_id from (select distinct name from raw_names) n
           left join employees e on lower(first_name || ' ' || last_name) = lower(n.name) group by n.name""",
        ["raw_names", "employees"],
    ),
    "lookup_alias": Query(
        "name:text employee_id",
        lambda d: P.lookup_alias(d.raw_names, d.aliases),
        """select n.name, min(a.employee_id) as employee_id from (select distinct name from raw_names) n
           left join aliases a on trim(lower(alias_first || ' ' || alias_last)) = trim(lower(n.name)) group by n.name""",
        ["raw_names", "aliases"],
    ),
    "fuzzy_names": Query(
        "candidate:text employee_id score:num", _fuzzy, "select candidate, employee_id, score from fuzzy", ["fuzzy"]
    ),
    "resolve_people": Query(
        "name:text candidate:text method:text employee_id", resolved, "select * from resolved", ["resolved"]
    ),
    "resolution_of_all_events": Query(
        "method:text events with_employee",
        _events_resolved,
        """select method, count(*) as events, count(employee_id) as with_employee
           from raw_names join resolved using (name) group by method""",
        ["raw_names", "resolved"],
    ),
    "resolve_fixed_list": Query(
        "name:text employee_id",
        lambda d: P.resolve_fixed_list(d.raw_names, d.employees),
        """select n.name, coalesce(
             (select min(employee_id) from employees where lower(first_name || ' ' || last_name) = lower(n.name)),
             (select arg_min(e.employee_id, (c.pos, e.employee_id)) from candidates c
                join employees e on lower(first_name || ' ' || last_name) = lower(c.candidate) where c.name = n.name)) as employee_id
           from (select distinct name from raw_names) n""",
        ["raw_names", "employees", "candidates"],
    ),
    "people_to_create": Query(
        "master_id first_name:text last_name:text",
        lambda d: _link(d, 0),
        f"select employee_id as master_id, first_name, last_name from employees where employee_id in (select master_id from {LINK_HITS})",
        ["resolved", "linked_people", "employees"],
    ),
    "aliases_to_record": Query(
        "alias_first:text alias_last:text master_id",
        lambda d: _link(d, 1),
        f"""select split_part(trim(name), ' ', 1) as alias_first,
                   case when contains(trim(name), ' ') then substr(trim(name), strpos(trim(name), ' ') + 1) else '' end as alias_last,
                   min(master_id) as master_id
            from {LINK_HITS} h join employees e on e.employee_id = h.master_id
            where lower(first_name || ' ' || last_name) <> lower(name) group by all""",
        ["resolved", "linked_people", "employees"],
    ),
    "client_map": Query(
        "client_name:text client_id created:bool",
        _clients_map,
        f"""with fresh as (
              select k, row_number() over (order by left(md5(k), 3), k) + (select max(client_id) from clients) as id
              from (select distinct {KEY} as k from raw_clients where trim(client_name) <> '')
              where k not in (select {KEY} from clients))
            select distinct r.client_name, coalesce(c.client_id, f.id) as client_id, c.client_id is null as created
            from raw_clients r left join clients c on trim(lower(c.client_name)) = trim(lower(r.client_name))
            left join fresh f on f.k = trim(lower(r.client_name)) where trim(r.client_name) <> ''""",
        ["raw_clients", "clients"],
    ),
    "clients_to_create": Query(
        "client_id client_name:text",
        _clients_new,
        f"""select row_number() over (order by left(md5(k), 3), k) + (select max(client_id) from clients) as client_id, client_name
            from (select {KEY} as k, min(client_name) as client_name from raw_clients where trim(client_name) <> '' group by 1)
            where k not in (select {KEY} from clients)""",
        ["raw_clients", "clients"],
    ),
    "projects_to_create": Query(
        "project_id code:text name:text state:text",
        _projects,
        """with known as (select min(p_partkey) as project_id, lower('p-' || min(p_name)) as k from part group by p_brand)
           select row_number() over (order by left(md5(k), 3), k) + (select max(project_id) from known) as project_id,
                  code, 'Progetto ' || code as name, 'active' as state
           from (select lower('P-' || p_name) as k, min('P-' || p_name) as code from part group by 1)
           where k not in (select k from known)""",
    ),
    "bulk_link": Query(
        "employee_id first_name:text last_name:text master_id",
        lambda d: P.bulk_link(d.linked_people, d.employees, ["first_name", "last_name"]),
        """select p.employee_id, p.first_name, p.last_name, coalesce(p.master_id, m.employee_id) as master_id
           from linked_people p left join employees m
             on lower(m.first_name) = lower(p.first_name) and lower(m.last_name) = lower(p.last_name)""",
        ["linked_people", "employees"],
    ),
    "name_variants": Query(
        "master_id alias_first:text alias_last:text",
        lambda d: P.name_variants(d.linked_people, d.employees),
        """select distinct p.master_id, p.first_name as alias_first, p.last_name as alias_last
           from linked_people p join employees m on m.employee_id = p.master_id
           where p.first_name <> m.first_name or p.last_name <> m.last_name""",
        ["linked_people", "employees"],
    ),
    "unified_people": Query(
        "employee_id first_name:text last_name:text master_id",
        lambda d: P.unified(d.linked_people, d.employees, ["first_name", "last_name"]),
        """select p.employee_id, coalesce(m.first_name, p.first_name) as first_name,
                  coalesce(m.last_name, p.last_name) as last_name, p.master_id
           from linked_people p left join employees m on m.employee_id = p.master_id""",
        ["linked_people", "employees"],
    ),
    "consolidated_people": Query(
        "origin:text origin_id first_name:text last_name:text email:text daily_cost:num",
        _consolidated,
        """select origin, id as origin_id, first_name, last_name, email, daily_cost from (
             select 0 as rank, 'legacy' as origin, employee_id as id, first_name, last_name, 'x@example.com' as email, null as daily_cost
             from stored_people
             union all select 1, 'master', employee_id, first_name, last_name, null, daily_cost from employees
             union all select 2, 'linked', employee_id, first_name, last_name, null, null from linked_people)
           qualify row_number() over (partition by trim(lower(first_name)), trim(lower(last_name)) order by rank, id) = 1""",
        ["stored_people", "employees", "linked_people"],
    ),
    "review_queue": Query(
        "client_name:text source_type:text suggested_id confidence:num status:text",
        lambda d: P.review_queue(d.raw_clients, d.clients, _pending(d), "activities"),
        f"""with words as (select client_id, list_distinct(list_filter(regexp_split_to_array(lower(client_name), '[^a-z0-9]+'),
                                                              lambda w: length(w) >= 1)) as words from clients),
            weights as (select word, count(*) as df from (select unnest(words) as word from words) group by word),
            wanted as (
              select min(trim(client_name)) as client_name from raw_clients where trim(client_name) <> '' group by {KEY}
              having min({KEY}) not in (select {KEY} from clients)
                 and min({KEY}) not in (select lower('Azienda ' || translate(id::varchar, '0123456789', 'abcdefghij'))
                                        from queue where status = 'pending')),
            name_words as (
              select client_name, word, floor(ln(1.0::double + (select count(*) from clients)::double / coalesce(df, 1)::double)
                                              * 1000000.0::double + 0.5::double)::bigint as wt
              from (select client_name, unnest(list_distinct(list_filter(regexp_split_to_array(lower(client_name), '[^a-z0-9]+'),
                      lambda w: length(w) >= 1))) as word from wanted) left join weights using (word)),
            best as (
              select client_name, client_id from (
                select n.client_name, w.client_id, sum(wt) as s, any_value(total) as total
                from (select *, sum(wt) over (partition by client_name) as total from name_words) n
                join (select client_id, unnest(words) as word from words) w using (word) group by 1, 2)
              where s > 0.5::double * total
              qualify row_number() over (partition by client_name order by s desc, client_id) = 1)
            select client_name, 'activities' as source_type, client_id as suggested_id,
                   case when client_id is not null then 0.7 else 0.0 end as confidence, 'pending' as status
            from wanted left join best using (client_name)""",
        ["raw_clients", "clients", "queue"],
    ),
    "pending_queue": Query(
        "id client_name:text suggested_name:text assigned_name:text confidence:num created_at:text",
        lambda d: P.pending_queue(d.queue, d.clients),
        """select q.id, q.client_name, s.client_name as suggested_name, a.client_name as assigned_name, confidence, created_at
           from queue q left join clients s on s.client_id = suggested_id left join clients a on a.client_id = assigned_id
           where status = 'pending'""",
        ["queue", "clients"],
    ),
    "expected_members": Query(
        "first_name:text last_name:text present:bool employee_id variants",
        lambda d: P.expected_members(_expected(d), d.stored_people),
        """with e as (select distinct upper(left(lower(c_mktsegment), 1)) || substr(lower(c_mktsegment), 2) as first_name,
                     'Zz' || translate(c_custkey::varchar, '0123456789', 'abcdefghij') as last_name from customer)
           select e.first_name, e.last_name, count(case when p.first_name = e.first_name and p.last_name = e.last_name then 1 end) > 0 as present,
                  min(case when p.first_name = e.first_name and p.last_name = e.last_name then p.employee_id end) as employee_id,
                  count(p.employee_id) as variants
           from e left join stored_people p
             on contains(lower(p.first_name), lower(e.first_name)) or contains(lower(p.last_name), lower(e.first_name))
             or contains(lower(p.first_name), lower(e.last_name)) or contains(lower(p.last_name), lower(e.last_name))
           group by e.first_name, e.last_name""",
        ["stored_people"],
    ),
    "short_company_names": Query(
        "id short_name:text",
        lambda d: d.table("supplier").select(
            F.col("s_suppkey").alias("id"),
            TX.short_company_name(
                F.expr(
                    "concat(s_name, case s_suppkey % 5 when 0 then ' S.r.l.' when 1 then ' S.p.A.' when 2 then ' Solutions'"
                    " when 3 then ' Group' else ' and Sons' end)"
                )
            ).alias("short_name"),
        ),
        """select s_suppkey as id, case when s_suppkey % 5 = 4 then left(s_name || ' and Sons', 20) else s_name end as short_name
           from supplier""",
    ),
}
