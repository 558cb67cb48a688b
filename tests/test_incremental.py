"""Tables kept up to date batch by batch against a rebuild of everything."""

import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import day, rows, ts
from shiftlens.operators import kpi as K, validators as V
from shiftlens.operators.common import union_all
from shiftlens.operators.spine import period_bounds
from shiftlens.sinks import upsert as U
from shiftlens.sources import jobs as J
from shiftlens.streaming import live as L
from shiftlens.streaming.incremental import DailyTables

SCHEMAS = {
    "timesheets": "id long, employee_id long, client_id long, work_date date, start_ts timestamp, end_ts timestamp, hours decimal(5,2)",
    "activities": "id long, employee_id long, start_ts timestamp, end_ts timestamp, duration_hours decimal(5,2), description string, billable boolean",
    "calendar": "id long, employee_id long, start_ts timestamp, end_ts timestamp",
    "remote_sessions": "id long, employee_id long, start_ts timestamp",
    "vehicle_log": "id long, employee_id long, client_id long, work_date date, pickup_ts timestamp, return_ts timestamp",
    "absences": "id long, employee_id long, from_date date, to_date date, state string",
}


def fact(rng, feed, i):
    e, d = rng.choice([1, 2, 3, 4, None, 9]), rng.randint(1, 12)
    at = lambda hour, d=d: ts(f"2025-06-{d:02d} {hour:02d}:00")
    h = rng.randint(6, 12)
    if feed == "timesheets":
        return (i, e, rng.choice([10, 11, None, 99]), day(f"2025-06-{d:02d}"), at(h), at(h + rng.randint(0, 8)), D(rng.randint(0, 40)) / 4)
    if feed == "activities":
        end = rng.choice([at(h + 2), at(h, min(d + 3, 28)), at(h), None])
        return (i, e, at(h), end, D(rng.randint(1, 30)) / 4, rng.choice(["Remote work", "On site", None]), rng.random() < 0.7)
    if feed == "calendar":
        return (i, e, at(h), rng.choice([at(h + 3), at(h, min(d + 2, 28))]))
    if feed == "remote_sessions":
        return (i, e, at(h))
    if feed == "vehicle_log":
        return (i, e, rng.choice([10, 11, None]), day(f"2025-06-{d:02d}"), at(h), rng.choice([at(h + 1), None]))
    return (i, e, day(f"2025-06-{d:02d}"), day(f"2025-06-{min(d + rng.randint(0, 4), 28):02d}"), rng.choice(["approved", "rejected"]))


def frames(spark, facts):
    return {f: spark.createDataFrame(facts.get(f, []), SCHEMAS[f]) for f in SCHEMAS}


@pytest.fixture(scope="module")
def people(spark):
    employees = spark.createDataFrame(
        [(1, D("80"), True), (2, None, True), (3, D("60"), False), (4, D("90"), True)],
        "employee_id long, daily_cost decimal(8,2), active boolean",
    )
    clients = spark.createDataFrame([(10, "Alfa"), (11, "Beta")], "client_id long, client_name string")
    return employees, clients


def rebuilt(spark, people, facts):
    employees, clients = people
    f = frames(spark, {k: list(v.values()) for k, v in facts.items()})
    kpi = K.daily_kpi(employees, f["timesheets"], f["activities"], f["calendar"], f["remote_sessions"], f["vehicle_log"], clients)
    found = V.validate_all(
        employees, f["timesheets"], f["activities"], f["calendar"], f["remote_sessions"], f["vehicle_log"], f["absences"], clients
    )
    found = U.one_per_anomaly_key(union_all([found, K.alert_anomalies(kpi)]))
    return rows(kpi.drop("alerts")), rows(found.select(*U.ANOMALY_KEYS, "severity", "description", "findings"))


def kept(tables):
    kpi = tables.kpi().select(*[c for c in tables.kpi().columns if c not in ("work_date", "alerts")], "work_date")
    order = ["employee_id", "work_date"]
    kpi = kpi.select(*order, *[c for c in kpi.columns if c not in order])
    return rows(kpi), rows(tables.anomalies().select(*U.ANOMALY_KEYS, "severity", "description", "findings"))


def day_of(feed, row):
    if feed in ("timesheets", "vehicle_log"):
        return row[3]
    return row[2] if feed == "absences" else row[2].date()


def test_batches_with_late_repeated_and_changed_facts_equal_a_rebuild(spark, people, tmp_path):
    rng = random.Random(21)
    tables = DailyTables(spark, str(tmp_path / "t"), *people)
    facts = {f: {} for f in SCHEMAS}
    n = 0
    for step in range(3):
        batch = {f: [] for f in SCHEMAS}
        for f in SCHEMAS:
            for _ in range(12 if step == 0 else 5):
                n += 1
                batch[f].append(fact(rng, f, n))
            old = list(facts[f].values())
            for row in rng.sample(old, min(4, len(old))):
                changed = fact(rng, f, row[0])
                if changed[1] is None:
                    continue
                # The same start day: another end, employee, client, state.
                keep = 4 if f in ("timesheets", "vehicle_log") else 3
                batch[f].append((*changed[:2], *([changed[2]] if keep == 4 else []), row[keep - 1], *changed[keep:]))
            batch[f] += rng.sample(old, min(3, len(old)))  # sent again as they were
            seen = set()
            batch[f] = [r for r in batch[f] if not (r[0] in seen or seen.add(r[0]))]
            batch[f] += batch[f][:2]  # twice in one batch
            for row in batch[f]:
                facts[f][row[0]] = row
        tables.apply({f: d for f, d in frames(spark, batch).items()})
        if step in (0, 2):
            for got, want in zip(kept(tables), rebuilt(spark, people, facts)):
                assert set(got) == set(want) and len(got) == len(want)


def test_only_touched_days_are_read(spark, people, tmp_path):
    tables = DailyTables(spark, str(tmp_path / "t"), *people)
    rng = random.Random(22)
    tables.apply(frames(spark, {f: [fact(rng, f, i) for i in range(60)] for f in SCHEMAS}))
    days = spark.createDataFrame([(day("2025-06-03"),), (day("2025-06-04"),)], "work_date date")
    read = tables.stored(days)
    assert {p.split("work_date=")[1].split("/")[0] for p in read.inputFiles()} <= {f"2025-06-{d:02d}" for d in range(1, 29)}
    scanned = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [work_date" in scanned.replace("isnotnull(work_date", "work_date") or "PartitionFilters: [(work_date" in scanned
    before = {d.name: d.stat().st_mtime_ns for d in (tmp_path / "t" / "contributions").iterdir() if d.name.startswith("work_date=")}
    sheet = (999, 1, 10, day("2025-06-03"), ts("2025-06-03 08:00"), ts("2025-06-03 12:00"), D("4"))
    tables.apply({"timesheets": spark.createDataFrame([sheet], SCHEMAS["timesheets"])})
    after = {d.name: d.stat().st_mtime_ns for d in (tmp_path / "t" / "contributions").iterdir() if d.name.startswith("work_date=")}
    assert {d for d in after if after[d] != before.get(d)} == {"work_date=2025-06-03"}


def test_a_batch_that_failed_half_way_is_finished_by_the_next_run(spark, people, tmp_path, monkeypatch):
    tables = DailyTables(spark, str(tmp_path / "t"), *people)
    at = lambda d, h: ts(f"2025-06-{d:02d} {h:02d}:00")
    first = {
        "timesheets": [(1, 1, 10, day("2025-06-02"), at(2, 8), at(2, 12), D("4")), (2, 1, 10, day("2025-06-06"), at(6, 8), at(6, 12), D("4"))],
        "activities": [(5, 1, at(2, 8), at(5, 8), D("3"), "x", True)],
    }
    tables.apply(frames(spark, first))
    second = {"activities": [(5, 4, at(2, 8), at(3, 8), D("3"), "x", True)]}
    monkeypatch.setattr(DailyTables, "_kpi_of", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        tables.apply(frames(spark, second))
    monkeypatch.undo()
    tables.apply(frames(spark, second))
    facts = {f: {} for f in SCHEMAS}
    facts["timesheets"] = {r[0]: r for r in first["timesheets"]}
    facts["activities"] = {5: second["activities"][0]}
    assert kept(tables) == rebuilt(spark, people, facts)


def test_resolved_anomalies_stay_and_open_ones_go(spark, people, tmp_path):
    tables = DailyTables(spark, str(tmp_path / "t"), *people)
    short = lambda i, e, hours: (i, e, None, day("2025-06-03"), ts("2025-06-03 08:00"), ts("2025-06-03 10:00"), D(hours))
    tables.apply({"timesheets": spark.createDataFrame([short(1, 1, "2"), short(2, 2, "2")], SCHEMAS["timesheets"])})
    found = rows(tables.anomalies().where("type = 'insufficient_hours'"), "employee_id", "resolved")
    assert found == [(1, False), (2, False)]
    resolved = tables.anomalies().withColumn("resolved", F.col("employee_id") == 2)
    resolved.write.partitionBy("work_date").parquet(str(tmp_path / "r"))
    U._write(spark.read.parquet(str(tmp_path / "r")), tables.path("anomalies"), "work_date")
    tables.apply({"timesheets": spark.createDataFrame([short(1, 1, "8"), short(2, 2, "8")], SCHEMAS["timesheets"])})
    assert rows(tables.anomalies().where("type = 'insufficient_hours'"), "employee_id", "resolved") == [(2, True)]


def test_dates_far_off_are_errors_that_name_the_row(spark, people, tmp_path):
    sheet = (77, 1, 10, day("9999-06-03"), ts("9999-06-03 08:00"), ts("9999-06-03 12:00"), D("4"))
    sheets = spark.createDataFrame([sheet], SCHEMAS["timesheets"])
    tables = DailyTables(spark, str(tmp_path / "t"), *people, as_of="2025-12-31")
    with pytest.raises(Exception, match="timesheet 77 is dated 9999-06-03"):
        tables.apply({"timesheets": sheets})
    lo, hi = period_bounds(sheets, "2025-12-31")
    with pytest.raises(Exception, match="timesheet 77 is dated 9999-06-03, after 2025-12-31"):
        spark.range(1).select(lo, hi).collect()
    span = [(5, 1, ts("2025-06-03 08:00"), ts("2925-06-03 08:00"))]
    with pytest.raises(Exception, match="calendar 5 spans more than"):
        tables.apply({"calendar": spark.createDataFrame(span, SCHEMAS["calendar"])})


def test_nothing_is_no_batch(spark, people, tmp_path):
    tables = DailyTables(spark, str(tmp_path / "t"), *people)
    tables.apply({})
    tables.apply(frames(spark, {}))
    assert not (tmp_path / "t" / "kpi").exists()


def test_drop_folder_to_kpi_and_anomalies(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    paths = {n: str(tmp_path / n) for n in ("employees", "clients", "vehicles")}
    spark.createDataFrame(
        [(1, "Anna", "Verdi", True, D("80"))], "employee_id long, first_name string, last_name string, active boolean, daily_cost decimal(8,2)"
    ).write.parquet(paths["employees"])
    spark.createDataFrame([(10, "Alfa Srl")], "client_id long, client_name string").write.parquet(paths["clients"])
    spark.createDataFrame([(5, "Punto")], "vehicle_id long, vehicle_name string").write.parquet(paths["vehicles"])

    def dimensions():
        return J.Dimensions(**{n: spark.read.parquet(p) for n, p in paths.items()})

    def tables():
        d = dimensions()
        return DailyTables(spark, str(tmp_path / "t"), d.employees, d.clients)

    def run():
        L.process_folder(spark, str(drop), tables, dimensions, paths, str(tmp_path / "cp"), str(tmp_path / "bad"))

    head = "dipendente nome;dipendente cognome;cliente nome;ora inizio;ora fine;ore\n"
    (drop / "apprilevazionepresenze-timbrature-totali-base.csv").write_text(head + "Anna;Verdi;Alfa Srl;03/06/2025 08:00;03/06/2025 10:00;2\nx;y\n")
    (drop / "attivita.csv").write_text("Iniziata il;Conclusa il;Durata;Creato da\n03/06/2025 08:00;03/06/2025 10:00;2;Anna Verdi\n")
    run()
    t = tables()
    assert rows(t.kpi(), "employee_id", "work_date", "timesheet_hours", "billable_hours") == [(1, day("2025-06-03"), D("2.00"), D("2.00"))]
    assert "insufficient_hours" in {r.type for r in t.anomalies().collect()}
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
    # A later file corrects the hours and brings a person nobody knew; the layout is another.
    (drop / "apprilevazionepresenze-timbrature-totali-base-2.csv").write_text(
        "ORE,ora_fine,ora_inizio,Cliente Nome,Dipendente Cognome,Dipendente Nome\n"
        "8,03/06/2025 10:00,03/06/2025 08:00,Alfa Srl,Verdi,Anna\n7,04/06/2025 15:00,04/06/2025 08:00,Nuova Srl,Neri,Ugo\n"
    )
    run()
    t = tables()
    got = rows(t.kpi().where("timesheet_hours > 0"), "employee_id", "work_date", "timesheet_hours")
    assert got == [(1, day("2025-06-03"), D("8.00")), (2, day("2025-06-04"), D("7.00"))]
    assert t.kpi().count() == 4 and not t.anomalies().where("type = 'insufficient_hours'").count()
    before = kept(t)
    run()
    assert kept(tables()) == before


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_people_and_feeds_are_made_once_for_all_batches(spark, tmp_path):
    from shiftlens.plans import domain, incremental_queries as I

    at = ts("2024-01-02 08:00")
    data = {
        "events": [(i, at, i % 3, k, 6.0, '{"k": 1}') for i, k in enumerate(["view", "click", "signup", "error", "purchase"] * 4)],
        "customer": [(i, f"C{i}", 1, 1.0, "BUILDING") for i in range(3)],
        "nation": [(1, "NATION", 1)],
        "supplier": [(1, "S", 1, 1.0)],
        "part": [(i, "p", "b", "t", 1, 1.0) for i in range(4)],
    }
    for name, found in data.items():
        spark.createDataFrame(found, domain.SCHEMAS[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    d = domain.Domain(spark, str(tmp_path))
    tables, feeds = I._tables(d), I._feeds(d)
    for frame in (tables.employees, tables.clients, *feeds.values()):
        assert "Join" not in plan_of(frame) and "Aggregate" not in plan_of(frame)
    for feed, frame in feeds.items():
        assert rows(frame) == rows(getattr(d, feed)) and frame.dtypes == getattr(d, feed).dtypes


def test_anomaly_rules_share_one_read_of_the_touched_rows(spark, people, tmp_path, monkeypatch):
    seen = []
    real = V.overlaps
    monkeypatch.setattr(V, "overlaps", lambda sheets, *rest: seen.append(plan_of(sheets)) or real(sheets, *rest))
    tables = DailyTables(spark, str(tmp_path / "t"), *people)
    sheet = (1, 1, 10, day("2025-06-03"), ts("2025-06-03 08:00"), ts("2025-06-03 12:00"), D("4"))
    tables.apply({"timesheets": spark.createDataFrame([sheet], SCHEMAS["timesheets"])})
    assert seen and "Join" not in seen[0]
