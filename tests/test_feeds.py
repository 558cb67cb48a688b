"""Reading feeds, quarantining rows, normalising and loading them twice."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from shiftlens.sinks import upsert as U
from shiftlens.sources import feeds as FD, jobs as J

EMPLOYEES = [(1, "Anna", "Verdi", True), (2, "Luca", "De Santis", True)]


def dims(spark, projects=True):
    employees = spark.createDataFrame(EMPLOYEES, "employee_id long, first_name string, last_name string, active boolean")
    clients = spark.createDataFrame([(10, "Alfa Srl")], "client_id long, client_name string")
    vehicles = spark.createDataFrame([(5, "Punto")], "vehicle_id long, vehicle_name string")
    known = spark.createDataFrame([(7, "P1")], "project_id long, code string") if projects else None
    return J.Dimensions(employees, clients, vehicles, known)


def write(folder, name, text, encoding="utf-8"):
    (folder / name).write_bytes(text.encode(encoding))
    return str(folder / name)


def test_separators_and_types(spark, tmp_path):
    write(tmp_path, "a.csv", "x,y,z\n1,2,3\n")
    write(tmp_path, "b.csv", "x;y;z\n1;2;3\n")
    write(tmp_path, "c.csv", "x\ty\n1\t2\n")
    write(tmp_path, "d.csv", "x|y|z\n1|2|3\n")
    write(tmp_path, "tie.csv", "a,b;c\n1,2;3\n")
    write(tmp_path, "bom.csv", "﻿Computer,Utente\nx,y\n")
    write(tmp_path, "attivita.csv", "uno;due\n1;2\n")
    write(tmp_path, "ore.csv", "ora_inizio;ora_fine\n1;2\n")
    write(tmp_path, "tecnici.csv", "Creato da;Durata\n1;2\n")
    got = {r.file_name: r for r in FD.file_headers(spark, str(tmp_path)).collect()}
    assert {k: r.separator for k, r in got.items()} == {
        "a.csv": ",", "b.csv": ";", "c.csv": "\t", "d.csv": "|", "tie.csv": ",", "bom.csv": ",",
        "attivita.csv": ";", "ore.csv": ";", "tecnici.csv": ";",
    }
    assert got["bom.csv"].header == "Computer,Utente"
    assert got["bom.csv"].feed == "remote_sessions"
    assert got["attivita.csv"].feed == "activities"
    assert got["ore.csv"].feed == "timesheets"
    assert got["tecnici.csv"].feed == "activities"
    assert got["a.csv"].feed == "activities" and got["a.csv"].columns == 3


def test_profile_counts_lines_and_keeps_five(spark, tmp_path):
    write(tmp_path, "attivita.csv", "a;b\n" + "".join(f"{i};x\n" for i in range(12)))
    r = FD.file_profiles(spark, str(tmp_path)).first()
    assert (r.total_rows, r.columns, r.separator) == (13, 2, ";")
    assert list(r.preview) == [f"{i};x" for i in range(5)]


def test_corrupt_rows_and_encodings(spark, tmp_path):
    head = "Id Ticket;INIZIATA IL ;Conclusa il;Azienda;Descrizione;Durata;Creato da;Riferimento Progetto\n"
    good = '12;03/06/2025 09:00;03/06/2025 10:30;Alfa Srl;"  perché; sì\t ok ";1,5;Anna Verdi;P1\n'
    write(tmp_path, "attivita.csv", head + good + "1;2;3\n" + good.replace("12;", "13;").strip() + ";extra\n")
    feed = FD.read_feed(spark, str(tmp_path / "attivita.csv"), "activities")
    ok, bad = FD.split_corrupt(feed)
    assert rows(ok, "ticket", "start", "description", "duration", "person") == [
        ("12", "03/06/2025 09:00", "perché; sì ok", "1,5", "Anna Verdi")
    ]
    assert bad.count() == 2
    other = tmp_path / "latin"
    other.mkdir()
    write(other, "attivita.csv", head + good.replace("sì", "si – €"), encoding="cp1252")
    ok, _ = FD.split_corrupt(FD.read_feed(spark, str(other), "activities"))
    assert ok.first().description == "perché; si – € ok"


def test_activities_job(spark, tmp_path):
    head = "Id Ticket;Iniziata il;Conclusa il;Azienda;Descrizione;Durata;Creato da;Riferimento Progetto\n"
    body = (
        "12;03/06/2025 09:00;03/06/2025 10:30;alfa srl ;uno;1,5;Anna Verdi;P1\n"
        "0;03/06/2025 11:00;03/06/2025 12:00;Beta;due;1;De Santis, Luca;P2\n"
        "5;03/06/2025 11:00;03/06/2025 12:00;;tre;1;nobody@example.com;\n"
        "6;3/6/2025 9:05;3/6/2025 9:50;Gamma;quattro;0,75;Mario Neri Rossi;P2\n"
        "7;not a date;;Gamma;cinque;1;Anna Verdi;\n"
    )
    write(tmp_path, "attivita.csv", head + body)
    ok, _ = FD.split_corrupt(FD.read_feed(spark, str(tmp_path), "activities"))
    d = dims(spark)
    out = J.activities(ok, d)
    created = {k: rows(v) for k, v in out.created.items()}
    assert [r[1:] for r in created["employees"]] == [("Mario", "Neri Rossi")]
    assert created["employees"][0][0] == 3
    assert sorted(r[1] for r in created["clients"]) == ["Beta", "Gamma"]
    assert [r[1:3] for r in created["projects"]] == [("P2", "Progetto P2")]
    got = {r.description: r for r in out.rows.collect()}
    assert set(got) == {"uno", "due", "quattro"}
    assert (got["uno"].employee_id, got["uno"].client_id, got["uno"].project_id, got["uno"].ticket_id) == (1, 10, 7, "12")
    assert got["due"].employee_id == 2 and got["due"].ticket_id is None
    assert got["quattro"].employee_id == 3 and float(got["quattro"].duration_hours) == 0.75
    assert got["quattro"].start_ts == dt.datetime(2025, 6, 3, 9, 5)
    reasons = sorted(r[0] for r in out.rejects.select(J.REASON).collect())
    assert reasons == ["no readable start", "unknown person"]


def test_calendar_job_rejects_vehicles_and_missing(spark, tmp_path):
    text = (
        "SUMMARY;DTSTART;DTEND;NOTES;ATTENDEE;LOCATION;PRIORITY\n"
        '"Visita\tuno";03/06/2025 09:00;03/06/2025 10:00;"riga 1\nriga 2";Anna Verdi;Sede;0\n'
        "Auto;03/06/2025 09:00;03/06/2025 10:00;;Punto;;\n"
        "Vuoto;03/06/2025 09:00;03/06/2025 10:00;;;;3\n"
        "Nuovo;03/06/2025 09:00;03/06/2025 10:00;;Carla Gialli;;3\n"
    )
    write(tmp_path, "calendario.csv", text)
    ok, bad = FD.split_corrupt(FD.read_feed(spark, str(tmp_path), "calendar"))
    assert bad.count() == 0
    out = J.calendar(ok, dims(spark))
    got = {r.title: r for r in out.rows.collect()}
    assert set(got) == {"Visita uno", "Nuovo"}
    assert got["Visita uno"].priority == 5 and got["Nuovo"].priority == 3
    assert got["Visita uno"].note == "riga 1 riga 2"
    reasons = sorted(r[0] for r in out.rejects.select(J.REASON).collect())
    assert reasons == ["attendee is a vehicle", "no attendee"]


def test_remote_sessions_two_layouts(spark, tmp_path):
    write(
        tmp_path, "teamviewer_uno.csv",
        "﻿Assegnatario,Utente,Nome,E-mail,Codice,Tipo di sessione,Gruppo,Inizio,Fine,Durata,Tariffa\n"
        'Luca De Santis,,PC7,a@b.c,c1,,G,2025-06-03 09:38,2025-06-03 09:50,12m ,"0,50"\n',
    )
    write(
        tmp_path, "teamviewer_due.csv",
        "Utente,Computer,ID,Tipo di sessione,Gruppo,Inizio,Fine,Durata,Valuta,Tariffa,Calcolo,Note\n"
        "Anna Verdi,PC9,c2,Riunione,G,2025-06-03 10:00,2025-06-03 11:05,1:05,EUR,0,Fattura,x\n",
    )
    feed = FD.read_feed(spark, str(tmp_path / "teamviewer_*.csv"), "remote_sessions")
    ok, bad = FD.split_corrupt(feed)
    assert bad.count() == 0
    out = J.remote_sessions(ok, dims(spark))
    got = {r.session_code: r for r in out.rows.collect()}
    assert got["c1"].employee_id == 2 and got["c1"].duration_minutes == 12 and float(got["c1"].rate) == 0.5
    assert got["c1"].session_type == "Controllo remoto" and got["c1"].client_name == "PC7"
    assert got["c2"].employee_id == 1 and got["c2"].duration_minutes == 65 and got["c2"].client_name == "PC9"


def test_other_jobs(spark, tmp_path):
    write(
        tmp_path, "apprilevazionepresenze-timbrature-totali-base.csv",
        "dipendente nome;dipendente cognome;cliente nome;cliente indirizzo;cliente città;cliente provincia;ora inizio;ora fine;"
        "ore;ore arrotondate;centesimi al netto delle pause;pausa sessantesimi;descrizione attività;timbratura id\n"
        "Anna;Verdi;Beta;Via 1;Roma;RM;03/06/2025 08:00;03/06/2025 17:00;9,00;9;8,25;0:45;x;1\n"
        "Nuova;Persona;;;;;03/06/2025 08:00;03/06/2025 12:00;4;4;4;;x;2\n",
    )
    write(
        tmp_path, "apprilevazionepresenze-richieste.csv",
        "Data della richiesta;Dipendente;Tipo;Data inizio;Data fine;Stato;Note\n"
        "01/06/2025;Verdi, Anna;Ferie;03/06/2025;05/06/2025;Approvata;\n"
        "01/06/2025;De Santis, Luca;Altro;03/06/2025;03/06/2025;Boh;n\n",
    )
    write(
        tmp_path, "progetti.csv",
        "Codice Progetto;Stato;Priorità;Azienda Assegnataria;Nome;Capo Progetto;Creato il\n"
        "P9;Sospeso;Alta;Beta;Nono;Anna Verdi;01/02/2025\nP8;x;;Beta;Ottavo;;01/02/2025 10:00\n",
    )
    write(
        tmp_path, "registro_auto.csv",
        "Dipendente;Data;Auto;Presa Data e Ora;Riconsegna Data e Ora;Cliente\n"
        "Anna Verdi;03/06/2025;Punto;03/06/2025 08:00;;Alfa Srl\n"
        "Luca De Santis;03/06/2025;Panda;03/06/2025 08:00;03/06/2025 09:30;\n",
    )
    found = FD.read_directory(spark, str(tmp_path), str(tmp_path / "staged"))
    assert found["calendar"] is None and found["activities"] is None and found["remote_sessions"] is None
    d = dims(spark)
    sheet = J.timesheets(FD.split_corrupt(found["timesheets"])[0], d)
    got = {r.source_id: r for r in sheet.rows.collect()}
    assert float(got["1"].hours) == 9 and float(got["1"].net_hours) == 8.25 and got["1"].pause_minutes == 45
    assert got["2"].employee_id == 3 and got["2"].client_id is None
    assert rows(sheet.created["clients"], "client_name", "client_city") == [("Beta", "Roma")]
    away = {r.employee_id: r for r in J.absences(FD.split_corrupt(found["absences"])[0], d).rows.collect()}
    assert (away[1].type, away[1].state, str(away[1].to_date)) == ("ferie", "approved", "2025-06-05")
    assert (away[2].type, away[2].state) == ("permessi", "pending")
    proj = {r.code: r for r in J.projects(FD.split_corrupt(found["projects"])[0], d).rows.collect()}
    assert (proj["P9"].state, proj["P9"].priority, proj["P9"].lead_id) == ("suspended", "high", 1)
    assert (proj["P8"].state, proj["P8"].priority, proj["P8"].lead_id) == ("active", "medium", None)
    log = J.vehicle_log(FD.split_corrupt(found["vehicle_log"])[0], d)
    got = {r.employee_id: r for r in log.rows.collect()}
    assert got[1].vehicle_id == 5 and got[1].return_ts is None and got[1].client_id == 10
    assert got[2].return_ts == dt.datetime(2025, 6, 3, 9, 30)
    assert rows(log.created["vehicles"], "vehicle_name") == [("Panda",)]


def test_loading_twice_inserts_nothing_new(spark, tmp_path):
    head = "Dipendente;Data;Auto;Presa Data e Ora;Riconsegna Data e Ora;Cliente\n"
    write(tmp_path, "registro_auto.csv", head + "Anna Verdi;03/06/2025;Punto;03/06/2025 08:00;;Alfa Srl\n" * 2)
    raw = FD.read_feed(spark, str(tmp_path / "registro_auto.csv"), "vehicle_log", staging=str(tmp_path / "staged"))
    out = J.vehicle_log(FD.split_corrupt(raw)[0], dims(spark))
    first = {r.outcome: r.rows for r in J.import_counts("vehicle_log", raw, out).collect()}
    assert first == {"processed": 2, "inserted": 1, "updated": 0, "duplicates": 1, "corrupt": 0, "rejected": 0}
    batch = U.last_per_key(out.rows, out.keys, out.refresh)
    empty = batch.limit(0)
    once = U.upsert_columns(empty, batch, out.keys, out.refresh)
    twice = U.upsert_columns(once, batch, out.keys, out.refresh)
    assert rows(once) == rows(twice) and once.count() == 1
    again = {r.outcome: r.rows for r in J.import_counts("vehicle_log", raw, out, once).collect()}
    assert again["inserted"] == 0 and again["updated"] == 1


def test_most_rows_without_a_known_name(spark):
    feed = spark.range(1000).select(
        F.when(F.col("id") % 10 == 0, "Anna Verdi").when(F.col("id") % 3 == 0, None).otherwise("pc-17").alias("person"),
        F.col("id").cast("string").alias("start"),
    )
    mapped, created = J.staff_map(feed, dims(spark).employees, dims(spark).vehicles)
    out = J.attach_by_name(feed, "person", mapped, "start")
    assert created.count() == 0 and out.columns == ["person", "start", "employee_id"]
    assert rows(out.groupBy("employee_id").count()) == [(1, 100), (None, 900)]


def test_rows_without_a_readable_end_or_number_are_rejected(spark):
    raw = spark.createDataFrame(
        [("Anna Verdi", "2025-06-01 08:00", None, "1", "a"), ("Anna Verdi", "2025-06-01 08:00", "soon", "1", "b"),
         ("Anna Verdi", "2025-06-01 08:00", "2025-06-01 09:00", "123456789", "c"), ("Anna Verdi", "2025-06-01 08:00", "2025-06-01 09:00", "1", "d")],
        "person string, start string, end string, duration string, description string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("client_name", "ticket", "project_code")})
    out = J.activities(raw, dims(spark))
    assert rows(out.rows, "description") == [("d",)]
    assert rows(out.rejects, "description", J.REASON) == [
        ("a", "no readable end"), ("b", "no readable end"), ("c", "number out of range")]
