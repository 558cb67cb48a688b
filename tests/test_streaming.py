import datetime as dt

from pyspark.sql import functions as F

from conftest import day, rows, ts
from shiftlens.sources import jobs as J
from shiftlens.streaming import live as L
from test_feeds import dims

SHEET = "employee_id long, start_ts timestamp, hours decimal(5,2)"


def batch(spark, path, data, schema, name):
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{path}/{name}")


def test_live_hours_updates_and_ignores_late_rows(spark, tmp_path):
    from decimal import Decimal as D

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batch(spark, source, [(1, ts("2025-06-03 08:00"), D("4")), (1, ts("2025-06-03 13:00"), D("3.5"))], SHEET, "a")
    stream = spark.readStream.schema(SHEET).option("recursiveFileLookup", True).parquet(source)

    def run():
        def write(df, i):
            df.write.mode("append").parquet(out)

        q = (
            L.live_hours(stream).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        q.awaitTermination(120)
        q.stop()

    run()
    batch(spark, source, [(1, ts("2025-06-03 18:00"), D("1")), (2, ts("2025-06-09 09:00"), D("2"))], SHEET, "b")
    run()
    batch(spark, source, [(1, ts("2025-06-03 19:00"), D("9"))], SHEET, "c")
    run()
    latest = spark.read.parquet(out).groupBy("employee_id", "work_date").agg(F.max("timesheet_hours"), F.max("punches"))
    assert rows(latest) == [(1, day("2025-06-03"), D("8.50"), 3), (2, day("2025-06-09"), D("2.00"), 1)]


def test_first_occurrences_drop_copies_of_later_batches(spark, tmp_path):
    from decimal import Decimal as D

    schema = "id long, employee_id long, start_ts timestamp, duration_hours decimal(5,2), ticket_id int"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    a = (1, 1, ts("2025-06-03 08:00"), D("1.5"), 7)
    batch(spark, source, [a, (2, *a[1:]), (3, 1, ts("2025-06-03 09:00"), D("1.5"), None)], schema, "a")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source)

    def run():
        q = (
            L.first_occurrences(stream).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        q.awaitTermination(120)
        q.stop()

    run()
    batch(spark, source, [(4, *a[1:])], schema, "b")
    run()
    got = spark.read.parquet(out)
    assert got.count() == 2 and got.select("activity_hash").distinct().count() == 2


def test_drop_folder_upserts_by_key(spark, tmp_path):
    header = "Dipendente;Data;Auto;Presa Data e Ora;Riconsegna Data e Ora;Cliente"
    drop = tmp_path / "drop"
    drop.mkdir()
    table, staging = str(tmp_path / "table"), str(tmp_path / "staging")
    line = "Anna Verdi;03/06/2025;Punto;03/06/2025 08:00;{};Alfa Srl\n"
    d = dims(spark)

    def run():
        feed = L.stream_feed(spark, str(drop), "vehicle_log", header, ";")
        q = L.upsert_stream(
            feed, table, staging, ["employee_id", "vehicle_id", "work_date", "pickup_ts"], ["return_ts"],
            "work_date", str(tmp_path / "cp"), prepare=lambda b: J.vehicle_log(b, d).rows,
        ).trigger(availableNow=True).start()
        q.awaitTermination(180)
        q.stop()

    (drop / "one.csv").write_text(header + "\n" + line.format("") * 2)
    run()
    assert spark.read.parquet(table).count() == 1
    (drop / "two.csv").write_text(header + "\n" + line.format("03/06/2025 10:00"))
    run()
    got = spark.read.parquet(table).collect()
    assert len(got) == 1 and got[0].return_ts == dt.datetime(2025, 6, 3, 10, 0)


def test_new_people_of_two_batches_get_different_ids(spark, tmp_path):
    header = "Dipendente;Data;Auto;Presa Data e Ora;Riconsegna Data e Ora;Cliente"
    drop = tmp_path / "drop"
    drop.mkdir()
    table, staging = str(tmp_path / "table"), str(tmp_path / "staging")
    paths = {n: str(tmp_path / n) for n in ("employees", "clients", "vehicles")}
    d = dims(spark)
    for name, path in paths.items():
        getattr(d, name).write.parquet(path)
    before = d.employees.count()

    def prepare(batch):
        return J.vehicle_log(batch, J.Dimensions(**{n: spark.read.parquet(p) for n, p in paths.items()}))

    def run(name, person):
        line = f"{person};03/06/2025;Punto;03/06/2025 08:00;03/06/2025 10:00;Nuova Srl\n"
        (drop / name).write_text(header + "\n" + line)
        feed = L.stream_feed(spark, str(drop), "vehicle_log", header, ";")
        q = L.upsert_stream(
            feed, table, staging, ["employee_id", "vehicle_id", "work_date", "pickup_ts"], ["return_ts"],
            "work_date", str(tmp_path / "cp"), prepare=prepare, dimensions=paths,
        ).trigger(availableNow=True).start()
        q.awaitTermination(180)
        q.stop()

    run("one.csv", "Ugo Neri")
    run("two.csv", "Ada Bruni")
    people = spark.read.parquet(paths["employees"])
    assert people.count() == before + 2 and people.select("employee_id").distinct().count() == before + 2
    facts = spark.read.parquet(table)
    assert facts.select("employee_id").distinct().count() == 2 and facts.select("client_id").distinct().count() == 1
    assert facts.join(people, "employee_id").count() == 2
