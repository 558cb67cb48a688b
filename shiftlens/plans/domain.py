"""Workforce frames derived from the test tables.

The same rules, as SQL for the comparison engine, are the ``FRAMES`` of ``oracles.py``.
Every frame covers its whole source table.  Seconds and cents are cut off with floor: a
plain rule that every engine agrees on.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.session import use_utc

# Column types of the test tables: stated here, so that opening a table starts no job.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}

# The person field of a feed row, by event id, in the spellings feeds use.
FULL = "concat(first_name, ' ', last_name)"
PERSON = f"""case event_id % 10 when 0 then {FULL} when 1 then upper({FULL})
    when 2 then concat(last_name, ', ', first_name) when 3 then concat(first_name, ' ', substring(last_name, 1, 4))
    when 4 then concat('Info / ', {FULL}) when 5 then last_name when 6 then 'Van 12'
    when 7 then concat('u', employee_id, '@example.com')
    when 8 then concat('Nuovo Tecnico', translate(cast(employee_id as string), '0123456789', 'abcdefghij'))
    else concat({FULL}, ' e Altro Collega') end"""
CLIENT = """case o_orderkey % 5 when 0 then concat('Supplier#', lpad(cast(o_custkey as string), 9, '0'))
    when 1 then concat('supplier#', lpad(cast(o_custkey as string), 9, '0'), ' ')
    when 2 then concat('Supplier ', lpad(cast(o_custkey as string), 9, '0'), ' Italia')
    when 3 then concat('Azienda ', translate(cast(o_custkey as string), '0123456789', 'abcdefghij'))
    else '' end"""

CENTS = "cast(cast(floor({0} * 100D) as decimal(18,0)) * cast(0.01 as decimal(3,2)) as decimal(5,2))"
SHIFT = "least(value / 20D, 12D)"


def _later(seconds: str) -> str:
    return f"timestampadd(SECOND, cast(floor({seconds}) as bigint), ts0)"


# Feed lines made of events: four files that differ in separator, order and spelling of columns.
# Some cells hold separators and quotes; some lines have a cell too few, one too many, or an open quote.
LINE_CELLS = {
    "ticket": "cast(event_id % 97 as varchar(20))",
    "person": "concat('Anna ', cast(user_id as varchar(20)), case event_id % 5 when 0 then '  Maria ' else '' end)",
    "client": """case event_id % 6 when 0 then '"Alfa, Beta; Gamma | Delta"' when 1 then '"detta ""La Prima"" Srl"'
        when 2 then concat('" ', event_type, chr(9), 'x "') when 3 then '' else concat('Ditta ', event_type) end""",
    "duration": """concat('"', cast(event_id % 9 as varchar(20)), ',', cast(event_id % 4 as varchar(20)), '5"')""",
    "other": "concat('Riga ', cast(event_id as varchar(20)))",
}
LINE_FILES = [
    (",", ["ticket", "person", "client", "duration"], ["Id Ticket", "Creato da", "Azienda", "Durata"]),
    (";", ["person", "duration", "client", "ticket"], ['"Creato da"', " DURATA", "azienda", "ID TICKET "]),
    ("\t", ["client", "ticket", "other", "duration", "person"], ["Azienda", "Id Ticket", "Descrizione", "Durata", "creato da"]),
    ("|", ["other", "duration", "person"], ["altro", "Durata", "Creato da"]),
]


def feed_lines_sql() -> str:
    """SQL that both engines run: (file, name, position, line), the header at position -1."""
    rows, headers = [], []
    for k, (sep, cells, header) in enumerate(LINE_FILES):
        mark = "chr(9)" if sep == "\t" else f"'{sep}'"
        line = f", {mark}, ".join(LINE_CELLS[c] for c in cells)
        broken = (
            f"case when event_id % 13 = 5 then concat('meno', {mark}, 'x') when event_id % 13 = 7 then concat({line}, {mark}, 'extra') "
            f"when event_id % 29 = 3 then concat({line}, '\"') when event_id % 31 = 4 then '  ' else concat({line}) end"
        )
        rows.append(f"when {k} then {broken}")
        text = f", {mark}, ".join("'" + h + "'" for h in header)
        headers.append(f"select 'file{k}' as file, 'attivita_{k}.csv' as name, cast(-1 as bigint) as position, concat({text}) as line")
    return (
        f"select concat('file', cast(event_id % 4 as varchar(20))) as file, concat('attivita_', cast(event_id % 4 as varchar(20)), '.csv') as name, "
        f"event_id as position, case event_id % 4 {' '.join(rows)} end as line from events union all " + " union all ".join(headers)
    )


class Domain:
    """Lazy frames over one directory of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = use_utc(spark)
        self.dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            reader = self.spark.read
            if name in SCHEMAS:
                reader = reader.schema(SCHEMAS[name])
            self._tables[name] = reader.parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    def _events(self, kind: str) -> DataFrame:
        return (
            self.table("events")
            .where(f"event_type = '{kind}'")
            .selectExpr("*", "date_trunc('second', cast(ts as timestamp)) as ts0")
        )

    @cached_property
    def employees(self) -> DataFrame:
        """People seen in the events, named from the customer and nation tables."""
        seen = self.table("events").selectExpr("user_id as employee_id").distinct()
        named = seen.join(
            self.table("customer"), F.expr("employee_id = c_custkey"), "left"
        ).join(self.table("nation"), F.expr("c_nationkey = n_nationkey"), "left")
        return named.selectExpr(
            "employee_id",
            "initcap(lower(c_mktsegment)) as first_name",
            "concat('Zz', translate(cast(employee_id as string), '0123456789', 'abcdefghij'), ' ', "
            "initcap(translate(lower(n_name), '_0123456789', 'xabcdefghij'))) as last_name",
            "c_name as full_name",
            "case when employee_id % 7 <> 0 then cast(80 + (employee_id % 3) * 60 as decimal(8,2)) end as daily_cost",
            "employee_id % 10 <> 0 as active",
        )

    @cached_property
    def clients(self) -> DataFrame:
        return self.table("supplier").selectExpr("s_suppkey as client_id", "s_name as client_name")

    @cached_property
    def vehicles(self) -> DataFrame:
        """One vehicle per part size."""
        sizes = self.table("part").selectExpr("cast(p_size as bigint) as vehicle_id").distinct()
        return sizes.selectExpr(
            "vehicle_id",
            "concat('Van ', vehicle_id) as vehicle_name",
            "cast(0.35 as decimal(5,2)) as cost_km",
        )

    @cached_property
    def timesheets(self) -> DataFrame:
        return self._events("view").selectExpr(
            "event_id as id",
            "user_id as employee_id",
            "case when event_id % 4 <> 0 then event_id % 10 end as client_id",
            "to_date(ts0) as work_date",
            "ts0 as start_ts",
            f"{_later(SHIFT + ' * 3600D')} as end_ts",
            f"{CENTS.format(SHIFT)} as hours",
        )

    @cached_property
    def activities(self) -> DataFrame:
        parts = self.table("part")
        part_count = parts.agg(F.count(F.lit(1))).scalar()
        rows = self._events("click").selectExpr(
            "event_id as id",
            "user_id as employee_id",
            "event_id % 10 as client_id",
            "cast(regexp_extract(props, '([0-9]+)', 1) as int) as ticket",
            "ts0 as start_ts",
            f"{_later('value * 600D')} as end_ts",
            f"{CENTS.format('greatest(value / 60D, 0.01D)')} as duration_hours",
            "event_id % 5 <> 0 as billable",
        )
        rows = rows.withColumn("part_key", F.col("id") % part_count)
        texts = parts.selectExpr("p_partkey", "concat_ws(', ', p_name, p_type, p_brand) as words")
        return rows.join(texts, F.expr("part_key = p_partkey"), "left").selectExpr(
            "id",
            "employee_id",
            "client_id",
            "case when ticket % 10 <> 0 then ticket end as ticket_id",
            "start_ts",
            "end_ts",
            "duration_hours",
            "case when id % 11 <> 0 then concat(case when id % 3 = 0 then 'Remote support: ' "
            "else 'On-site visit: ' end, words) end as description",
            "billable",
        )

    @cached_property
    def activities_reimported(self) -> DataFrame:
        """The activities and a second import of all of them.  By id, the second copy is
        exact, two minutes later with one word less and a longer duration, two minutes
        later, or four minutes later."""
        k = "id % 4"
        shift = f"case {k} when 0 then 0 when 3 then 4 else 2 end"
        again = self.activities.selectExpr(
            "2 * id + 1 as id",
            "employee_id",
            "client_id",
            "ticket_id",
            f"timestampadd(MINUTE, {shift}, start_ts) as start_ts",
            f"timestampadd(MINUTE, {shift}, end_ts) as end_ts",
            f"cast(duration_hours + case when {k} = 1 then 0.01 else 0.00 end as decimal(5,2)) as duration_hours",
            f"case when {k} = 1 then regexp_replace(description, ' [^ ]+$', '') else description end as description",
            "billable",
        )
        return self.activities.withColumn("id", F.expr("2 * id")).unionByName(again)

    @cached_property
    def timesheets_reimported(self) -> DataFrame:
        """The timesheets and a second import of them, some with a later end."""
        again = self.timesheets.selectExpr(
            "2 * id + 1 as id",
            "employee_id",
            "client_id",
            "work_date",
            "start_ts",
            "timestampadd(MINUTE, case when id % 3 = 2 then 5 else 0 end, end_ts) as end_ts",
            "hours",
        )
        return self.timesheets.withColumn("id", F.expr("2 * id")).unionByName(again)

    @cached_property
    def calendar(self) -> DataFrame:
        return self._events("signup").selectExpr(
            "event_id as id",
            "user_id as employee_id",
            "ts0 as start_ts",
            f"{_later('value * 60D')} as end_ts",
        )

    @cached_property
    def remote_sessions(self) -> DataFrame:
        return self._events("error").selectExpr(
            "event_id as id", "user_id as employee_id", "ts0 as start_ts"
        )

    @cached_property
    def vehicle_log(self) -> DataFrame:
        return self._events("purchase").selectExpr(
            "event_id as id",
            "user_id as employee_id",
            "event_id % 60 as vehicle_id",
            "event_id % 10 as client_id",
            "to_date(ts0) as work_date",
            "ts0 as pickup_ts",
            f"case when event_id % 5 <> 0 then {_later('value * 60D')} end as return_ts",
            "case when event_id % 9 <> 0 then cast(floor(value) as int) end as km",
        )

    @cached_property
    def absences(self) -> DataFrame:
        return self._events("signup").selectExpr(
            "event_id as id",
            "user_id as employee_id",
            "to_date(ts0) as from_date",
            "date_add(to_date(ts0), cast(event_id % 3 as int)) as to_date",
            "case event_id % 4 when 0 then 'pending' when 3 then 'rejected' else 'approved' end as state",
        )

    # ------------------------------------------------------------ names and master data

    @cached_property
    def stored_people(self) -> DataFrame:
        """Customers as stored people, with the faults that hand-typed names show."""
        k = "c_custkey % 12"
        return self.table("customer").selectExpr(
            "c_custkey as employee_id",
            f"""case {k} when 0 then 'Punto' when 1 then 'Admin' when 2 then 'Al' when 3 then concat('u', c_custkey, '@example.com')
                when 4 then repeat('Lungo', 11) when 5 then cast(c_custkey as string) when 6 then 'Anna/Bruno'
                when 7 then 'Carla, Dino' when 8 then 'Elio' else initcap(lower(c_mktsegment)) end as first_name""",
            f"""case {k} when 0 then '' when 2 then '' when 8 then 'Ferri; Gatti - Lodi'
                else concat('Zz', translate(cast(c_custkey as string), '0123456789', 'abcdefghij')) end as last_name""",
        )

    @cached_property
    def linked_people(self) -> DataFrame:
        """Stored counterparts of the employees, most of them linked, some spelled otherwise."""
        k = "employee_id"
        return self.employees.selectExpr(
            f"{k} + 1000000 as employee_id",
            "first_name",
            f"case when {k} % 5 = 0 then concat(last_name, ' jr') else last_name end as last_name",
            f"case when {k} % 3 <> 0 then {k} end as master_id",
        )

    @cached_property
    def raw_names(self) -> DataFrame:
        """The person field of every event, in the spellings feeds use."""
        e = self.table("events").selectExpr("event_id", "user_id as employee_id", "ts")
        p = self.employees.select("employee_id", "first_name", "last_name")
        return e.join(p, "employee_id").selectExpr("event_id", "ts", f"{PERSON} as name")

    @cached_property
    def aliases(self) -> DataFrame:
        from shiftlens.operators.people import generate_aliases

        return generate_aliases(self.employees, {"Building": "Bill", "Machinery": "Mac"})

    @cached_property
    def raw_clients(self) -> DataFrame:
        """The client field of every order, in the spellings feeds use."""
        return self.table("orders").selectExpr("o_orderkey", f"{CLIENT} as client_name")

    @cached_property
    def queue(self) -> DataFrame:
        """Review queue: one entry per order whose client is known by key."""
        return self.table("orders").selectExpr(
            "o_orderkey as id",
            "concat('client ', o_custkey) as client_name",
            "case when o_orderkey % 3 <> 0 then o_custkey % 120 end as suggested_id",
            "case when o_orderkey % 4 = 0 then o_custkey % 100 end as assigned_id",
            "case when o_orderkey % 3 <> 0 then 0.7D else 0.0D end as confidence",
            "case o_orderstatus when 'P' then 'pending' when 'F' then 'assigned' else 'rejected' end as status",
            "cast(o_orderdate as timestamp) as created_at",
        )

    # ------------------------------------------------------------ feeds as text

    def feed(self, kind: str) -> DataFrame:
        """The events of a kind as the text fields of a feed: every event is a row."""
        e = self._events(kind)
        p = self.employees.select("employee_id", "first_name", "last_name")
        rows = e.join(p, e["user_id"] == p["employee_id"]).join(
            self.table("orders"), F.expr("event_id = o_orderkey"), "left"
        )
        end = "timestampadd(SECOND, cast(floor(value * 60D) as bigint), ts0)"
        return rows.selectExpr(
            "cast(event_id as string) as code",
            f"{PERSON} as person",
            "concat(last_name, ', ', first_name) as surname_first",
            "case when event_id % 10 = 8 then 'Nuovo' else first_name end as first_name",
            "last_name",
            f"nullif(trim({CLIENT}), '') as client_name",
            """case event_id % 3 when 0 then date_format(ts0, 'd/M/yyyy H:mm:ss') when 1 then date_format(ts0, 'yyyy-MM-dd HH:mm:ss')
               else date_format(ts0, 'dd/MM/yyyy HH:mm') end as start""",
            f"case when event_id % 5 <> 0 then date_format({end}, 'yyyy-MM-dd HH:mm') end as end",
            "case when event_id % 2 = 0 then replace(cast(floor(value * 100) / 100 as string), '.', ',') "
            "else cast(floor(value * 100) / 100 as string) end as amount",
            """case event_id % 4 when 0 then concat(event_id % 97, 'm') when 1 then concat(event_id % 5, ':', lpad(event_id % 60, 2, '0'))
               when 2 then cast(event_id % 200 as string) else concat(event_id % 3, 'h ', event_id % 60, 'm') end as duration""",
            "regexp_extract(props, '([0-9]+)', 1) as ticket",
            "element_at(array('Ferie', 'ROL', 'Malattia', 'Altro', 'Permessi'), cast(event_id % 5 + 1 as int)) as type",
            "element_at(array('Approvata', 'Rifiutata', 'In attesa', '?'), cast(event_id % 4 + 1 as int)) as state",
            "element_at(array('Alta', 'Media', 'Bassa', 'Critica', ''), cast(event_id % 5 + 1 as int)) as priority",
            "concat('Van ', event_id % 60) as vehicle_name",
        )

    @cached_property
    def feed_lines(self) -> DataFrame:
        """Every event as a line of one of four feed files (see ``feed_lines_sql``)."""
        return self.spark.sql(feed_lines_sql().replace("from events", "from {events}"), events=self.table("events"))
