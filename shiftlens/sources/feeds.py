"""Delimited feeds: what they are called, which columns they have, and how to read them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from shiftlens.functions.text import first_filled, repair_encoding

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Feed:
    """``pattern`` of the file names, accepted header spellings per field, and whether
    quoted fields may hold line breaks (such files cannot be split between tasks)."""

    pattern: str
    fields: dict[str, list[str]]
    multiline: bool = False


# File names and header spellings of the feeds.
FEEDS = {
    "timesheets": Feed(
        "apprilevazionepresenze-timbrature-totali-base.csv",
        {
            "first_name": ["dipendente nome"],
            "last_name": ["dipendente cognome"],
            "client_name": ["cliente nome"],
            "client_address": ["cliente indirizzo"],
            "client_city": ["cliente città"],
            "client_province": ["cliente provincia"],
            "start": ["ora inizio", "ora_inizio"],
            "end": ["ora fine", "ora_fine"],
            "hours": ["ore"],
            "rounded_hours": ["ore arrotondate"],
            "net_hours": ["centesimi al netto delle pause"],
            "pause": ["pausa sessantesimi"],
            "start_address": ["indirizzo start"],
            "start_city": ["città start"],
            "start_province": ["provincia start"],
            "end_address": ["indirizzo end"],
            "end_city": ["città end"],
            "end_province": ["provincia end"],
            "description": ["descrizione attività"],
            "source_id": ["timbratura id"],
        },
    ),
    "absences": Feed(
        "apprilevazionepresenze-richieste.csv",
        {
            "requested": ["Data della richiesta"],
            "person": ["Dipendente"],
            "type": ["Tipo"],
            "from": ["Data inizio"],
            "to": ["Data fine"],
            "state": ["Stato"],
            "note": ["Note"],
        },
    ),
    "activities": Feed(
        "attivita.csv",
        {
            "contract": ["Contratto"],
            "ticket": ["Id Ticket"],
            "start": ["Iniziata il"],
            "end": ["Conclusa il"],
            "client_name": ["Azienda"],
            "description": ["Descrizione"],
            "duration": ["Durata"],
            "person": ["Creato da"],
            "project_code": ["Riferimento Progetto"],
        },
    ),
    "calendar": Feed(
        "calendario.csv",
        {
            "title": ["SUMMARY"],
            "start": ["DTSTART"],
            "end": ["DTEND"],
            "note": ["NOTES"],
            "person": ["ATTENDEE"],
            "location": ["LOCATION"],
            "priority": ["PRIORITY"],
        },
        multiline=True,
    ),
    "projects": Feed(
        "progetti.csv",
        {
            "code": ["Codice Progetto", "Codice"],
            "name": ["Nome", "Nome Progetto"],
            "state": ["Stato"],
            "priority": ["Priorità", "Priorita"],
            "client_name": ["Azienda Assegnataria", "Azienda"],
            "lead": ["Capo Progetto", "Responsabile"],
            "created": ["Creato il", "Data Inizio"],
            "due": ["Scadenza", "Data Scadenza"],
            "hours_budget": ["Ore Previste", "Budget Ore"],
        },
    ),
    "vehicle_log": Feed(
        "registro_auto.csv",
        {
            "person": ["Dipendente"],
            "date": ["Data"],
            "vehicle_name": ["Auto"],
            "pickup": ["Presa Data e Ora"],
            "return": ["Riconsegna Data e Ora"],
            "client_name": ["Cliente"],
        },
    ),
    "remote_sessions": Feed(
        "teamviewer_*.csv",
        {
            "person": ["Utente", "Assegnatario"],
            "client_name": ["Nome", "Computer"],
            "client_email": ["E-mail"],
            "session_code": ["Codice", "ID"],
            "session_type": ["Tipo di sessione"],
            "group": ["Gruppo"],
            "start": ["Inizio"],
            "end": ["Fine"],
            "duration": ["Durata"],
            "rate": ["Tariffa"],
            "billing_mode": ["Calcolo"],
            "description": ["Descrizione"],
            "note": ["Note"],
            "classification": ["Classificazione"],
        },
    ),
}
# Separators in the order that breaks ties.
SEPARATORS = [",", ";", "\t", "|"]


# ---------------------------------------------------------------- headers and profiles


def header_key(name: str) -> str:
    """A header cell without byte-order mark, quotes, outer blanks and letter case."""
    return name.strip(" \t\n\r\0\x0b﻿\"'").lower()


def raw_text(value: Column) -> Column:
    """Text lines keep the bytes of the file: UTF-8 where valid, else Windows-1252."""
    return repair_encoding(F.decode(value.cast("binary"), "ISO-8859-1"))


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file; ``position`` orders the lines of one file."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
        F.col("value"),
    )


def separator_of(header: Column) -> Column:
    """The most frequent separator of a header line; the first wins a tie."""
    counts = [F.length(header) - F.length(F.replace(header, F.lit(s), F.lit(""))) for s in SEPARATORS]
    top = F.greatest(*counts)
    choice = F.when(header == "", F.lit(";"))
    for sep, n in zip(SEPARATORS, counts):
        choice = choice.when(n == top, F.lit(sep))
    return choice


def feed_type_of(file_name: Column, header: Column) -> Column:
    """Feed type from the file name, else from the header, else activities."""
    name, head = F.lower(file_name), F.lower(header)
    return (
        F.when(name.contains("attivita"), "activities")
        .when(name.contains("timbrature"), "timesheets")
        .when(name.contains("teamviewer"), "remote_sessions")
        .when(name.contains("calendario"), "calendar")
        .when(head.contains("creato da") & head.contains("durata"), "activities")
        .when(head.contains("ora_inizio") & head.contains("ora_fine"), "timesheets")
        .when(head.contains("computer") | head.contains("sessione"), "remote_sessions")
        .otherwise("activities")
    )


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: name, size, header line, separator, number of columns, feed type, and
    whether all of it is valid UTF-8.

    Reads the text of the files once; pass ``sep`` and ``header`` to ``read_feed`` to do
    without."""
    at_start = F.when(F.col("block") == 0, F.col("position"))
    first = (
        file_lines(spark, path)
        .groupBy("file_path", "file_name", "file_size")
        .agg(
            F.min_by("value", at_start).alias("raw"),
            F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        )
    )
    header = F.regexp_replace(raw_text(F.col("raw")), "^﻿", "")
    return (
        first.withColumn("header", header)
        .withColumn("separator", separator_of(F.col("header")))
        .select(
            "file_path",
            "file_name",
            "file_size",
            "header",
            "separator",
            F.size(F.split("header", F.concat(F.lit("\\Q"), "separator", F.lit("\\E")))).alias("columns"),
            feed_type_of(F.col("file_name"), F.col("header")).alias("feed"),
            "utf8",
        )
    )


def file_profiles(spark: SparkSession, path: str, preview_rows: int = 5) -> DataFrame:
    """Separator, header, columns, number of lines and size of every file, and its first
    data lines.  Lines are counted with map-side aggregation; the preview keeps the lowest
    positions only."""
    lines = file_lines(spark, path)
    counts = lines.groupBy("file_path").agg(F.count(F.lit(1)).alias("total_rows"))
    starts = lines.where("block = 0").groupBy("file_path").agg(F.min("position").alias("p0"))
    near = (
        lines.where("block = 0")
        .join(starts, "file_path")
        .where((F.col("position") > F.col("p0")) & (F.col("position") <= F.col("p0") + preview_rows))
        .groupBy("file_path")
        .agg(F.array_sort(F.collect_list(F.struct("position", raw_text(F.col("value")).alias("line")))).alias("p"))
    )
    return (
        file_headers(spark, path)
        .join(counts, "file_path")
        .join(near, "file_path", "left")
        .select(
            "file_path", "file_name", "feed", "separator", "header", "columns", "total_rows",
            F.round(F.col("file_size") / 1024, 2).alias("size_kb"),
            F.coalesce(F.col("p.line"), F.array().cast("array<string>")).alias("preview"),
        )
    )


# ---------------------------------------------------------------- reading


def _columns_of(header: str, sep: str) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for cell in header.split(sep):
        key = header_key(cell)
        seen[key] = seen.get(key, 0) + 1
        out.append(key if seen[key] == 1 else f"{key}__{seen[key]}")
    return out


def read_layout(
    spark: SparkSession, paths: list[str], columns: list[str], sep: str, multiline: bool = False, utf8: bool = True
) -> DataFrame:
    """Files of one layout as text columns, plus the corrupt-record and file-name columns.

    Files that are not UTF-8 throughout are taken byte for byte and repaired per value.
    Column pruning is off, or a row with a wrong number of columns could pass unnoticed.
    Spark refuses a query that reads nothing but the corrupt-record column, so that column
    also reads the first one.
    """
    first = F.col(f"`{columns[0]}`")
    corrupt = F.coalesce(F.col(CORRUPT), F.nullif(first, first)).alias(CORRUPT)
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in columns] + [T.StructField(CORRUPT, T.StringType())]
    )
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("encoding", "UTF-8" if utf8 else "ISO-8859-1")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)
        .csv(paths)
    )

    def value(c: str) -> Column:
        return F.col(f"`{c}`") if utf8 else repair_encoding(F.col(f"`{c}`")).alias(c)

    return raw.select(*[value(c) for c in columns], corrupt, F.col("_metadata.file_name").alias("_file"))


def to_fields(raw: DataFrame, feed: Feed) -> DataFrame:
    """Engine fields of a feed; spellings that are absent are skipped, blanks are NULL."""
    present = set(raw.columns)

    def field(spellings: list[str]) -> Column:
        found = [F.col(f"`{header_key(s)}`") for s in spellings if header_key(s) in present]
        return first_filled(*found) if found else F.lit(None).cast("string")

    return raw.select(
        *[field(spellings).alias(name) for name, spellings in feed.fields.items()],
        F.col(CORRUPT),
        F.col("_file"),
    )


def read_feed(
    spark: SparkSession,
    path: str,
    feed: str,
    sep: str | None = None,
    header: str | None = None,
    utf8: bool = True,
    staging: str | None = None,
) -> DataFrame:
    """Rows of a feed with its engine fields.  Rows whose number of columns differs from the
    header carry the raw line in ``_corrupt_record``.

    Without ``sep`` and ``header`` every file is read by its own header and separator (see
    ``lines``).  A job reads its feed several times (names, clients, rows, rejects); with
    ``staging`` the text is parsed once into a parquet table there and all further reads are
    columnar.
    """
    from shiftlens.sources.lines import read_mixed

    spec = FEEDS[feed]
    if sep is not None and header is not None:
        out = to_fields(read_layout(spark, [path], _columns_of(header, sep), sep, spec.multiline, utf8), spec)
    else:
        out = read_mixed(spark, path, spec)
    if staging is None:
        return out
    out.write.mode("overwrite").parquet(staging)
    return spark.read.parquet(staging)


def read_directory(
    spark: SparkSession, directory: str, staging: str | None = None
) -> dict[str, DataFrame | None]:
    """Every known feed of a folder; a feed without files is ``None``."""
    from pyspark.errors import AnalysisException

    out: dict[str, DataFrame | None] = {}
    for name, feed in FEEDS.items():
        try:
            table = f"{staging.rstrip('/')}/{name}" if staging else None
            out[name] = read_feed(spark, f"{directory.rstrip('/')}/{feed.pattern}", name, staging=table)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            out[name] = None
    return out


def split_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound rows, quarantined raw lines)."""
    good = rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = rows.where(F.col(CORRUPT).isNotNull()).select("_file", F.col(CORRUPT).alias("line"))
    return good, bad
