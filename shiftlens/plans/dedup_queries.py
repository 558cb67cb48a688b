"""Queries over the duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shiftlens.operators import dedup as D, groups as G
from shiftlens.plans.domain import Domain
from shiftlens.plans.registry import Query

GROUP = "duplicates first_id last_id"
DAY = "to_date(start_ts) as work_date"


def _decisions(d: Domain) -> DataFrame:
    return D.find_duplicates(d.activities_reimported)


def _prefix(length: int, coalesced: bool) -> str:
    text = "coalesce(description, '')" if coalesced else "description"
    return f"left({text}, {length}) as text_start"


def _groups_sql(keys: str, table: str) -> str:
    names = ", ".join(k.split(" as ")[-1].strip() for k in keys.split(";"))
    exprs = ", ".join(keys.split(";"))
    return f"""select {names}, count(*) as duplicates, min(id) as first_id, max(id) as last_id
               from (select id, {exprs} from {table}) group by {names} having count(*) > 1"""


def _activity_groups(columns: str, keys: list[str], sql_keys: str) -> Query:
    return Query(
        f"{columns} {GROUP}",
        lambda d: G.duplicate_groups(d.activities_reimported, [F.expr(k) for k in keys]),
        _groups_sql(sql_keys, "activities_re"),
        ["activities_re"],
    )


def _documents(d: Domain) -> DataFrame:
    """Whole texts, keyed by a digest so that the shuffle does not carry the text."""
    return d.table("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))


NEAR_REPEATS_SQL = """
    with recursive firsts as (
      select employee_id, start_ts, duration_hours, min(id) as id, epoch(start_ts)::bigint as s,
             duration_hours::double as dur
      from activities_re group by employee_id, start_ts, duration_hours),
    ranked as (select *, row_number() over (partition by employee_id order by id) as rk from firsts),
    steps as (
      select employee_id, rk, id, [{'id': id, 's': s, 'dur': dur}] as kept,
             null::struct(gap bigint, id bigint) as best
      from ranked where rk = 1
      union all
      select employee_id, rk, id,
             case when hits = [] then list_append(kept, {'id': id, 's': s, 'dur': dur}) else kept end,
             list_sort(hits)[1]
      from (select r.*, g.kept,
                   list_transform(list_filter(g.kept, lambda k: abs(r.s - k.s) // 60 <= 3 and abs(r.dur - k.dur) < 0.1::double),
                                  lambda k: {'gap': abs(r.s - k.s) // 60, 'id': k.id}) as hits
            from steps g join ranked r on r.employee_id = g.employee_id and r.rk = g.rk + 1))
    select a.id, case when st.best is not null then st.best.id else f.id end as original_id
    from activities_re a
    join firsts f on f.employee_id = a.employee_id and f.start_ts = a.start_ts and f.duration_hours = a.duration_hours
    join steps st on st.id = f.id
    where st.best is not null or a.id <> f.id"""

MERGED_SQL = """
    select target as id,
           (list_sort(list({'n': -coalesce(strlen(trim(description)), 0), 'id': id, 't': trim(description)})))[1].t as description,
           (list_sort(list({'id': -id, 't': ticket_id}) filter (where ticket_id is not null and ticket_id <> 0)))[1].t as ticket_id,
           count(*) - 1 as merged
    from (select m.original_id as target, a.id, a.description, a.ticket_id
          from decisions m join activities_re a on a.id = m.id where m.action = 'merge'
          union all
          select a.id, -1, a.description, a.ticket_id from activities_re a
          where a.id in (select original_id from decisions where action = 'merge'))
    group by target"""

DECISION = (
    "id activity_hash:text action:text duplicate_type:text original_id confidence:num minutes_apart"
)

QUERIES = {
    "activity_hash": Query(
        "id activity_hash:text",
        lambda d: d.activities.select("id", D.activity_hash().alias("activity_hash")),
        """select id, md5(concat_ws('|', employee_id::varchar, strftime(start_ts, '%Y-%m-%d %H:%M:%S'),
                                    duration_hours::varchar, coalesce(ticket_id::varchar, ''))) as activity_hash
           from activities""",
        ["activities"],
    ),
    "find_duplicates": Query(DECISION, _decisions, "select * from decisions", ["decisions"]),
    "decision_counts": Query(
        "duplicates_detected duplicates_merged duplicates_marked duplicates_skipped unique_inserted",
        lambda d: D.decision_counts(_decisions(d)),
        """select count(*) filter (where action <> 'insert') as duplicates_detected,
                  count(*) filter (where action = 'merge') as duplicates_merged,
                  count(*) filter (where action = 'mark') as duplicates_marked,
                  count(*) filter (where action = 'skip') as duplicates_skipped,
                  count(*) filter (where action = 'insert') as unique_inserted from decisions""",
        ["decisions"],
    ),
    "merged_originals": Query(
        "id description:text ticket_id merged",
        lambda d: D.merged_originals(d.activities_reimported, _decisions(d)),
        MERGED_SQL,
        ["activities_re", "decisions"],
    ),
    "deduplicated_activities": Query(
        "id employee_id description:text ticket_id activity_hash:text is_duplicate:bool original_id "
        "duplicate_reason:text confidence:num",
        lambda d: D.apply_decisions(d.activities_reimported, _decisions(d)),
        f"""select a.id, a.employee_id, coalesce(m.description, a.description) as description,
                   coalesce(m.ticket_id, a.ticket_id) as ticket_id, activity_hash, action = 'mark' as is_duplicate,
                   case when action = 'mark' then original_id end as original_id,
                   case when action = 'mark' then duplicate_type || ' duplicate' end as duplicate_reason,
                   case when action = 'mark' then confidence end as confidence
            from activities_re a join decisions using (id) left join ({MERGED_SQL}) m on m.id = a.id
            where action not in ('merge', 'skip')""",
        ["activities_re", "decisions"],
    ),
    "near_repeats": Query(
        "id original_id",
        lambda d: D.near_repeats(d.activities_reimported),
        NEAR_REPEATS_SQL,
        ["activities_re"],
    ),
    "mark_exact_duplicates": Query(
        "id is_duplicate:bool original_id duplicate_reason:text confidence:num",
        lambda d: G.mark_duplicates(d.activities_reimported, ["employee_id", "start_ts", "duration_hours"]),
        """select id, id <> f as is_duplicate, case when id <> f then f end as original_id,
                  case when id <> f then 'exact duplicate' end as duplicate_reason,
                  case when id <> f then 1.0 end as confidence
           from (select id, min(id) over (partition by employee_id, start_ts, duration_hours) as f from activities_re)""",
        ["activities_re"],
    ),
    "cleanup_dry_run": Query(
        "analyzed marked",
        lambda d: G.cleanup_counts(d.activities_reimported, ["employee_id", "start_ts", "duration_hours"]),
        """select count(*) as analyzed, coalesce(sum(n - 1), 0) as marked from (
             select count(*) as n from activities_re group by employee_id, start_ts, duration_hours having count(*) > 1)""",
        ["activities_re"],
    ),
    "keep_first_activity": Query(
        "id employee_id duration_hours:num description:text",
        lambda d: G.keep_first(d.activities_reimported, ["employee_id", "start_ts", "duration_hours"]),
        """select * from activities_re
           where id in (select min(id) from activities_re group by employee_id, start_ts, duration_hours)""",
        ["activities_re"],
    ),
    "groups_by_day_duration": _activity_groups(
        "employee_id work_date:text duration_hours:num",
        ["employee_id", DAY, "duration_hours"],
        "employee_id; start_ts::date as work_date; duration_hours",
    ),
    "groups_by_start_duration": _activity_groups(
        "employee_id start_ts:text duration_hours:num",
        ["employee_id", "start_ts", "duration_hours"],
        "employee_id; start_ts; duration_hours",
    ),
    "groups_by_start_duration_text": _activity_groups(
        "employee_id start_ts:text duration_hours:num text_start:text",
        ["employee_id", "start_ts", "duration_hours", _prefix(50, True)],
        "employee_id; start_ts; duration_hours; left(coalesce(description, ''), 50) as text_start",
    ),
    "groups_by_start_duration_text_or_null": _activity_groups(
        "employee_id start_ts:text duration_hours:num text_start:text",
        ["employee_id", "start_ts", "duration_hours", _prefix(50, False)],
        "employee_id; start_ts; duration_hours; left(description, 50) as text_start",
    ),
    "groups_by_all_fields": _activity_groups(
        "employee_id start_ts:text end_ts:text duration_hours:num text_start:text client_id",
        ["employee_id", "start_ts", "end_ts", "duration_hours", _prefix(100, True), "client_id"],
        "employee_id; start_ts; end_ts; duration_hours; left(coalesce(description, ''), 100) as text_start; client_id",
    ),
    "groups_of_timesheets": Query(
        f"employee_id work_date:text start_ts:text end_ts:text {GROUP}",
        lambda d: G.duplicate_groups(d.timesheets_reimported, ["employee_id", "work_date", "start_ts", "end_ts"]),
        _groups_sql("employee_id; work_date; start_ts; end_ts", "timesheets_re"),
        ["timesheets_re"],
    ),
    "groups_of_timesheet_starts": Query(
        f"employee_id work_date:text start_ts:text {GROUP}",
        lambda d: G.duplicate_groups(d.timesheets_reimported, ["employee_id", "work_date", "start_ts"]),
        _groups_sql("employee_id; work_date; start_ts", "timesheets_re"),
        ["timesheets_re"],
    ),
    "duplicate_members": Query(
        "id first_id duplicates",
        lambda d: G.duplicate_members(d.activities_reimported, ["employee_id", "start_ts", "duration_hours"]),
        """select * from (select id, min(id) over w as first_id, count(*) over w as duplicates from activities_re
                          window w as (partition by employee_id, start_ts, duration_hours)) where duplicates > 1""",
        ["activities_re"],
    ),
    "suspect_days": Query(
        "suspect_days",
        lambda d: D.suspect_days(d.activities_reimported),
        """select count(*) as suspect_days from (
             select 1 from activities_re group by employee_id, start_ts::date having count(*) > 3)""",
        ["activities_re"],
    ),
    "duplication_factor": Query(
        "total distinct_rows surplus factor:num",
        lambda d: G.duplication_factor(d.activities_reimported, ["employee_id", "start_ts", "duration_hours"]),
        """select count(*) as total, count(distinct (employee_id, start_ts, duration_hours)) as distinct_rows,
                  count(*) - count(distinct (employee_id, start_ts, duration_hours)) as surplus,
                  floor(count(*)::double / count(distinct (employee_id, start_ts, duration_hours))::double * 100.0::double + 0.5::double)
                    / 100.0::double as factor
           from activities_re""",
        ["activities_re"],
    ),
    "lineitem_duplication_factor": Query(
        "total distinct_rows surplus factor:num",
        lambda d: G.duplication_factor(d.table("lineitem"), ["l_orderkey", "l_linenumber"]),
        """select count(*) as total, count(distinct (l_orderkey, l_linenumber)) as distinct_rows,
                  count(*) - count(distinct (l_orderkey, l_linenumber)) as surplus,
                  floor(count(*)::double / count(distinct (l_orderkey, l_linenumber))::double * 100.0::double + 0.5::double)
                    / 100.0::double as factor
           from lineitem""",
    ),
    "lineitem_first_wins": Query(
        "l_orderkey l_linenumber l_partkey l_suppkey l_quantity:num l_extendedprice:num l_shipdate:text",
        lambda d: G.keep_first(
            d.table("lineitem").select(
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"
            ),
            ["l_orderkey", "l_linenumber"],
            ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"],
        ),
        """select * from lineitem
           qualify row_number() over (partition by l_orderkey, l_linenumber
             order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) = 1""",
    ),
    "document_copies": Query(
        "id is_duplicate:bool original_id duplicate_reason:text confidence:num",
        lambda d: G.mark_duplicates(_documents(d), ["digest"], reason="same text"),
        """select id, id <> f as is_duplicate, case when id <> f then f end as original_id,
                  case when id <> f then 'same text' end as duplicate_reason,
                  case when id <> f then 1.0 end as confidence
           from (select doc_id as id, min(doc_id) over (partition by text) as f from documents)""",
    ),
}
