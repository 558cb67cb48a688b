"""Field parsers, name rules and settings."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from conftest import rows, ts
from shiftlens import settings as ST
from shiftlens.functions import names as NM, temporal as TM, text as TX


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_dates(spark):
    values = ["4/6/2025 9:00", "04/06/2025 09:00:07", "2025-06-03 09:38", "32/01/2025", " ", None, "2025-06-03", "3/6/2025"]
    assert apply(spark, values, TM.parse_datetime) == [
        ts("2025-06-04 09:00"), ts("2025-06-04 09:00:07"), ts("2025-06-03 09:38"), None, None, None,
        ts("2025-06-03 00:00"), ts("2025-06-03 00:00"),
    ]
    assert apply(spark, ["4/6/2025", "2025-06-04", "4/6/2025 9:00", "2025-06-04 10:00:00", "x"], TM.parse_date) == [
        dt.date(2025, 6, 4)
    ] * 4 + [None]
    assert apply(spark, ["4/6/2025 9:05", "2025-06-03 09:38"], TM.parse_time) == ["09:05:00", None]


def test_numbers_and_durations(spark):
    assert apply(spark, ["0,00", "1,5", "", None, "7.25h", "-3"], TX.parse_decimal) == [0, 1.5, 0, 0, 7.25, -3]
    assert apply(spark, ["2m ", "48", "1:05", "1h 5m", "", None], TX.parse_duration_minutes) == [2, 48, 65, 65, 0, 0]
    assert apply(spark, ["0:45", "90", "", None], TX.parse_clock_minutes) == [45, 0, 0, 0]


def test_minutes_are_truncated(spark):
    df = spark.createDataFrame([(ts("2025-06-03 09:00:30"), ts("2025-06-03 09:02:00"))], "a timestamp, b timestamp")
    m = TM.minutes_between(F.col("a"), F.col("b"))
    assert df.select(m, TM.minutes_between(F.col("b"), F.col("a"))).first()[:] == (1, -1)


def test_clean_and_fill(spark):
    assert apply(spark, ['  "a\t b"\n', "'x'", None, '"'], TX.clean_value) == ["a b", "x", "", '"']
    df = spark.createDataFrame([(" ", "b"), ("a", "b"), (None, "")], "x string, y string")
    filled = TX.first_filled(F.col("x"), F.col("y"), default=F.lit("z"))
    assert [r[0] for r in df.select(filled).collect()] == ["b", "a", "z"]


def test_encoding(spark):
    texts = ["perché", "plain", "quote ’ €"]
    as_utf8 = [t.encode().decode("latin-1") for t in texts]
    as_cp = [t.encode("cp1252").decode("latin-1") for t in texts]
    assert apply(spark, as_utf8 + as_cp, TX.repair_encoding) == texts * 2


def test_categories_and_companies(spark):
    assert apply(spark, ["Ferie", "Permessi ex festività", "?", None], TX.absence_type) == [
        "ferie", "ex_festivita", "permessi", "permessi",
    ]
    assert apply(spark, ["Annullamento approvato", "x"], TX.absence_state) == ["cancelled", "pending"]
    assert apply(spark, ["Sospeso", "x"], TX.project_state) == ["suspended", "active"]
    assert apply(spark, ["Critica", None], TX.priority) == ["critical", "medium"]
    companies = ["Rossi S.r.l.", "Verdi S.p.A.", "Blu Solutions", "Big Corp", "Neri Group", "A very long company name indeed"]
    assert apply(spark, companies, TX.short_company_name) == ["Rossi", "Verdi", "Blu", "Big", "Neri", "A very long company "]


def test_severity_order(spark):
    df = spark.createDataFrame([("high",), ("low",), ("critical",), ("medium",)], "s string")
    assert [r[0] for r in df.orderBy(F.desc(TX.severity_rank(F.col("s")))).collect()] == ["critical", "high", "medium", "low"]


def test_names(spark):
    names = ["Anna Verdi", "punto", "Info", "a@b.it", "x", "a" * 51, "12345", "*star", "pc-22", "example.com", "", "D'Angelo", "Érica"]
    want = [True, False, False, False, False, False, False, False, False, False, False, True, True]
    assert apply(spark, names, NM.is_valid_person_name) == want
    assert apply(spark, ["", "Rossi"], lambda c: NM.is_valid_person_name(c, allow_empty=True)) == [True, True]
    split = ["Anna Verdi/Luca Bo", "Bo, Luca", "Anna Verdi", "A; B & C", "Anna con Luca", "a/", "x e y"]
    assert apply(spark, split, NM.split_people) == [
        ["Anna Verdi", "Luca Bo"], ["Bo", "Luca"], ["Anna Verdi"], ["A", "B & C"], ["Anna", "Luca"], ["a/"], ["x", "y"],
    ]
    df = spark.createDataFrame([("Bo, Luca",), ("Anna De Luca",), ("Solo",)], "n string")
    given, family = NM.split_full_name(F.col("n"))
    assert [tuple(r) for r in df.select(given, family).collect()] == [("Luca", "Bo"), ("Anna", "De Luca"), ("Solo", "")]


def test_settings_from_config(spark):
    config = ST.default_config(spark).where("key <> 'alert_ore_minime'").unionByName(
        spark.createDataFrame([("alert_ore_minime", "6", "integer", "alert")], "key string, value string, type string, category string")
    )
    s = ST.Settings.from_config(config)
    assert s.min_hours == D("6") and s.hourly_rate == D("50.00") and s == ST.Settings(min_hours=D("6"))
    typed = {r.key: r for r in ST.typed_config(config, "kpi").collect()}
    assert set(typed) == {"efficiency_threshold_warning", "efficiency_threshold_critical", "profit_threshold_warning"}
    assert typed["efficiency_threshold_warning"].as_integer == 70 and typed["profit_threshold_warning"].as_float == -20.0
    assert rows(config.limit(0)) == []
