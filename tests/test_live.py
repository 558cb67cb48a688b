"""Live KPI rows, alert changes and the near-duplicate guard on streams."""

import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from conftest import day, rows, ts
from shiftlens.operators import dedup as DD, kpi as K
from shiftlens.streaming import guard as G, live_kpi as LK

SHEET = "employee_id long, client_id long, work_date date, hours decimal(5,2)"
WORK = "employee_id long, start_ts timestamp, end_ts timestamp, duration_hours decimal(5,2), billable boolean"
PLAN = "employee_id long, start_ts timestamp, end_ts timestamp"


def put(spark, path, data, schema, name):
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{path}/{name}")


def test_kpi_rows_and_alert_changes_over_three_triggers(spark, tmp_path):
    employees = spark.createDataFrame([(1, D("80"), True), (2, D("90"), True)], "employee_id long, daily_cost decimal(8,2), active boolean")
    clients = spark.createDataFrame([(10, "Alfa")], "client_id long, client_name string")
    at = lambda h: ts(f"2025-06-03 {h:02d}:00")
    schemas = {"timesheets": SHEET, "activities": WORK, "calendar": PLAN}
    data = {n: [] for n in schemas}

    def arrive(step, **facts):
        for name, schema in schemas.items():
            put(spark, str(tmp_path / name), facts.get(name, []), schema, f"s{step}")
            data[name] += facts.get(name, [])
        streams = {n: spark.readStream.schema(s).option("recursiveFileLookup", True).parquet(str(tmp_path / n)) for n, s in schemas.items()}
        query = LK.keep_live(LK.live_measures(streams, clients), str(tmp_path / "live"), lambda: employees, str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination()

    def batch_rows():
        f = {n: spark.createDataFrame(data[n], s) for n, s in schemas.items()}
        none = spark.createDataFrame([], "employee_id long, start_ts timestamp")
        cars = spark.createDataFrame([], "employee_id long, work_date date, pickup_ts timestamp, return_ts timestamp")
        return K.daily_kpi(employees, f["timesheets"], f["activities"], f["calendar"], none, cars, clients, "2025-06-03", "2025-06-03")

    def changes():
        found = spark.read.parquet(str(tmp_path / "live/changes"))
        return rows(found, "employee_id", "code", "change")

    arrive(1, calendar=[(1, at(8), at(12))], activities=[(2, at(8), at(10), D("2"), True)])
    first = [(1, "missing_timesheet", "raised"), (2, "billable_without_timesheet", "raised")]
    assert [c for c in changes() if c[1] in ("missing_timesheet", "billable_without_timesheet")] == first
    arrive(2, calendar=[(1, at(13), at(14))])
    assert [c for c in changes() if c[1] == "missing_timesheet"] == first[:1]  # still open: not reported again
    arrive(3, timesheets=[(1, 10, day("2025-06-03"), D("5")), (2, 10, day("2025-06-03"), D("2"))])
    got = changes()
    assert (1, "missing_timesheet", "cleared") in got and (2, "billable_without_timesheet", "cleared") in got
    assert len(got) == len(set(got))
    live = spark.read.parquet(str(tmp_path / "live/kpi"))
    columns = [c for c in batch_rows().columns if c != "alerts"]
    assert rows(live, *columns) == rows(batch_rows(), *columns)
    open_now = spark.read.parquet(str(tmp_path / "live/alerts")).where("code is not null")
    assert rows(open_now, "employee_id", "code") == rows(batch_rows().select("employee_id", F.explode("alerts").alias("a")).select("employee_id", F.col("a.code").alias("code")))


ACTIVITY = "id long, employee_id long, start_ts timestamp, duration_hours decimal(5,2), ticket_id int, description string"


def test_guard_in_five_files_equals_the_batch_operator(spark, tmp_path):
    rng = random.Random(41)
    texts = ["check printer", "check printers", "check printer again", "new laptop", "new laptop and dock", "Perché no", "", None]
    data = []
    for i in range(400):
        minute = rng.randint(0, 90)
        data.append((i, rng.choice([1, 2]), ts(f"2025-06-03 {8 + minute // 60:02d}:{minute % 60:02d}"), D(rng.choice([100, 102, 105, 150])) / 100, rng.choice([5, 6, 0, None]), rng.choice(texts)))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(5):
        put(spark, source, data[80 * k : 80 * k + 80], ACTIVITY, f"f{k}")
        stream = spark.readStream.schema(ACTIVITY).option("recursiveFileLookup", True).parquet(source)
        query = G.guarded(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination()
    columns = ["id", "activity_hash", "action", "duplicate_type", "original_id", "minutes_apart"]
    want = DD.find_duplicates(spark.createDataFrame(data, ACTIVITY))
    got = spark.read.parquet(out)
    assert rows(got, *columns) == rows(want, *columns)
    near = {r.id: r.confidence for r in want.where("confidence is not null").collect()}
    assert len(near) > 40 and all(abs(near[r.id] - r.confidence) < 1e-9 for r in got.where("confidence is not null").collect())


def test_guard_forgets_what_the_watermark_has_passed(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    row = lambda i, d: (i, 1, ts(f"2025-06-{d:02d} 08:00"), D("1"), 5, "x")
    for k, part in enumerate([[row(1, 3)], [row(2, 9)], [row(3, 3)], [row(4, 9)]]):
        put(spark, source, part, ACTIVITY, f"f{k}")
        stream = spark.readStream.schema(ACTIVITY).option("recursiveFileLookup", True).parquet(source)
        query = G.guarded(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(out), "id", "action") == [(1, "insert"), (2, "insert"), (4, "mark")]


# ---------------------------------------------------------------- tables, loads and rollups


def test_bucketed_upsert_leaves_the_target_where_it_lies(spark):
    from shiftlens.sinks import bucketed as B, upsert as U

    t = spark.range(1000).selectExpr("id % 100 as employee_id", "id as v", "date_add(date'2024-01-01', cast(id div 100 as int)) as work_date")
    u = spark.range(150).selectExpr("id as employee_id", "-id as v", "date_add(date'2024-01-01', cast(id % 3 as int)) as work_date")
    B.write_bucketed(t, "bucketed_facts", ["employee_id"], "work_date", 6)
    with B.subset_of_keys(spark):
        plan = B.merged(spark.table("bucketed_facts"), u, ["employee_id"], "work_date", 6)
        text = plan._jdf.queryExecution().executedPlan().toString()
    target = text[text.index("SortMergeJoin") :]
    target = target[: target.index("+- Sort [_u_employee_id")]
    assert "Exchange" not in target and "InMemoryFileIndex(3 paths)" in text
    assert text.count("Exchange") == 1
    B.upsert_bucketed(spark, "bucketed_facts", u, ["employee_id"], "work_date", 6)
    want = U.upsert(t, u, ["employee_id", "work_date"])
    assert rows(spark.table("bucketed_facts"), "employee_id", "v", "work_date") == rows(want, "employee_id", "v", "work_date")
    try:
        B.upsert_bucketed(spark, "bucketed_facts", u.unionByName(u), ["employee_id"], "work_date", 6)
        raise AssertionError
    except ValueError as twice:
        assert "more than once" in str(twice)


def test_load_reads_its_source_once_and_counts_as_import_counts(spark, tmp_path):
    from shiftlens.sources import jobs as J, loading as LD
    from test_feeds import dims

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    lines = [("Anna Verdi", "03/06/2025", "Punto", f"03/06/2025 {8 + k % 5:02d}:00", "03/06/2025 18:00", "Alfa Srl", None) for k in range(12)]
    lines += [("Zz", "03/06/2025", "Punto", "03/06/2025 08:00", None, "", None), (None,) * 6 + ("broken;line",)]
    schema = "person string, date string, vehicle_name string, pickup string, return string, client_name string, _corrupt_record string"
    raw = spark.createDataFrame(lines, schema)
    counted = raw.mapInArrow(seen, schema)
    d = dims(spark)
    first = LD.load_feed("vehicle_log", counted, d, str(tmp_path / "a"))
    assert read.value == len(lines)
    good = raw.where("_corrupt_record is null").drop("_corrupt_record")
    plain = J.vehicle_log(good, d)
    want = {r.outcome: r.rows for r in J.import_counts("vehicle_log", raw, plain).collect()}
    assert first.counts == want and first.counts["duplicates"] == 7 and first.rows.count() == 6
    again = LD.load_feed("vehicle_log", counted, d, str(tmp_path / "b"), first.rows)
    assert again.counts["updated"] == 6 and again.counts["inserted"] == 0
    none = LD.load_feed("vehicle_log", raw.limit(0), d, str(tmp_path / "c"))
    assert set(none.counts.values()) == {0}


def test_distinct_members_of_windows_and_periods(spark):
    from shiftlens.operators import rollups as RU

    rng = random.Random(51)
    data = [(rng.choice([1, 2, None]), rng.choice([*range(40), 40_000, 70_001, None]), day(f"2025-06-{rng.randint(1, 28):02d}")) for _ in range(400)]
    frame = spark.createDataFrame(data, "client_id long, employee_id long, work_date date")
    maps = RU.daily_bitmaps(frame, "client_id", "employee_id")
    got = {(r.client_id, r.work_date): (r.members_3, r.members_10) for r in RU.distinct_in_windows(maps, "client_id", [3, 10]).collect()}
    known = [r for r in data if None not in r]
    for c in (1, 2):
        first, last = min(r[2] for r in known if r[0] == c), max(r[2] for r in known)
        for k in range((last - first).days + 1):
            d = first.replace(day=first.day + k)
            want = tuple(len({r[1] for r in known if r[0] == c and 0 <= (d - r[2]).days < n}) for n in (3, 10))
            assert got[(c, d)] == want
    period = dict(rows(RU.distinct_in_period(maps, "client_id", "2025-06-05", "2025-06-09")))
    assert period == {c: len({r[1] for r in known if r[0] == c and 5 <= r[2].day <= 9}) for c in (1, 2)}
    assert RU.distinct_in_windows(maps.limit(0), "client_id", [7]).count() == 0


def test_rollup_needs_one_exchange(spark):
    from shiftlens.operators import rollups as RU

    kpi = spark.createDataFrame(
        [(e, day(f"2025-0{m}-03"), D("8"), D("4"), D("200"), D("80"), D("120"), 1, 0, D("50")) for e in (1, 2) for m in (5, 6)],
        "employee_id long, work_date date, timesheet_hours decimal(18,2), billable_hours decimal(18,2), revenue decimal(18,2), "
        "daily_cost decimal(18,2), profit_loss decimal(18,2), remote_sessions long, vehicle_usage int, efficiency_rate decimal(18,2)",
    )
    out = RU.kpi_rollup(kpi)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange") == 1
    got = {(r.grain, r.employee_id, r.month and r.month.month, r.work_date and r.work_date.month): r.days for r in out.collect()}
    assert got[("all", None, None, None)] == 4 and got[("employee_id", 1, None, None)] == 2 and got[("employee_id_month", 2, 5, None)] == 1
    assert got[("work_date", None, None, 6)] == 2 and got[("month", None, 5, None)] == 2 and len(got) == 1 + 2 + 4 + 2 + 2
