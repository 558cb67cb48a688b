"""Feed files of mixed layouts, parsed line by line.

Files of one feed may differ in separator, in the order and spelling of their columns, and in
encoding.  The first line of each file is one row of a small table of layouts, which is joined onto
the lines: a line is split at its own file's separator, and its cells go to the fields by the names
in its own file's header.  Any number of files and layouts is one plan; no list of files, paths or
layouts comes to the driver, and a large file is split between tasks.

Separators and line breaks inside quotes do not count, wherever in a cell the quotes stand; two
quotes inside a quoted cell are one.  A line whose number of cells differs from the header's, or
that leaves a quote open, is no row; it is kept as it is with its file and place.  Blank lines are
skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shiftlens.functions.text import clean_value
from shiftlens.session import working_path
from shiftlens.sources.feeds import CORRUPT, Feed, file_lines, header_key, raw_text, separator_of

CUT = "￿"  # no character; stands for a separator that counts
HEADER_MARGIN = " \t\n\r\0\x0b﻿\"'"


def outside_quotes(text: Column, change) -> Column:
    """``text`` with ``change`` applied to what stands outside of double quotes."""
    pieces = F.transform(F.split(text, '"'), lambda p, i: F.when(i % 2 == 0, change(p)).otherwise(p))
    return F.array_join(pieces, '"')


def cells_of(line: Column, separator: Column) -> Column:
    """The cells of a line, quotes taken off."""
    cut = F.split(outside_quotes(line, lambda p: F.replace(p, separator, F.lit(CUT))), CUT)

    def unquoted(cell: Column) -> Column:
        body = F.trim(cell)
        quoted = (F.length(body) >= 2) & body.startswith('"') & body.endswith('"')
        inner = F.substring(body, F.lit(2), F.length(body) - 2)
        return F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(cell)

    return F.transform(cut, unquoted)


def leaves_quote_open(line: Column) -> Column:
    return F.size(F.split(line, '"')) % 2 == 0


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, position, line) of files whose rows are lines."""
    lines = file_lines(spark, path)
    return lines.select(
        F.col("file_path").alias("file"),
        F.col("file_name").alias("name"),
        F.struct("block", "position").alias("position"),
        raw_text(F.col("value")).alias("line"),
    )


def quoted_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, position, line) of files whose cells may hold line breaks; read file by file."""
    whole = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), raw_text(F.col("value")).alias("text")
    )
    rows = F.split(outside_quotes(F.col("text"), lambda p: F.regexp_replace(p, "\r\n|\r|\n", CUT)), CUT)
    return whole.select("file", "name", F.posexplode(rows).alias("position", "line"))


def layouts(lines: DataFrame, feed: Feed) -> DataFrame:
    """One row per file: its first place, separator, number of columns, and for every field of the
    feed the places of the columns it may stand in, best spelling first."""
    written = F.trim("line") != ""
    first = lines.where(written).groupBy("file").agg(
        F.min(F.struct("position", "line")).alias("first")
    )
    header = F.regexp_replace("first.line", "^﻿", "")
    named = first.select("file", F.col("first.position").alias("head"), header.alias("header")).withColumn(
        "separator", separator_of(F.col("header"))
    )
    keys = F.transform(cells_of(F.col("header"), F.col("separator")), lambda c: F.lower(F.btrim(c, F.lit(HEADER_MARGIN))))
    named = named.withColumn("keys", keys)

    def places(spellings: list[str]) -> Column:
        found = F.array(*[F.array_position("keys", header_key(s)).cast("int") for s in spellings])
        return F.filter(found, lambda p: p > 0)

    return named.select(
        "file", "head", "separator", F.size("keys").alias("columns"),
        F.struct(*[places(s).alias(n) for n, s in feed.fields.items()]).alias("places"),
    )


def parse_lines(lines: DataFrame, feed: Feed, layout: DataFrame | None = None) -> DataFrame:
    """Rows of (file, name, position, line): file, position, the fields of the feed, ``_file`` (its
    name) and ``_corrupt_record``, the line itself where it is no row.

    The layouts are written to a table first, so the join knows how small they are: the lines stay
    where they are unless there are very many files.
    """
    if layout is None:
        spark = lines.sparkSession
        path = working_path(spark, "layouts")
        found = layouts(lines, feed)
        found.write.parquet(path)
        layout = spark.read.schema(found.schema).parquet(path)
    known = layout.withColumnRenamed("file", "_of")
    rows = lines.join(known, F.col("file") == F.col("_of")).where((F.trim("line") != "") & (F.col("position") > F.col("head")))
    rows = rows.withColumn("cells", cells_of(F.col("line"), F.col("separator")))
    sound = (F.size("cells") == F.col("columns")) & ~leaves_quote_open(F.col("line"))
    rows = rows.withColumn("cells", F.when(sound, F.col("cells")))

    def field(name: str) -> Column:
        values = F.transform(f"places.{name}", lambda p: clean_value(F.get(F.col("cells"), p - 1)))
        return F.when(F.col("cells").isNotNull(), F.try_element_at(F.array_remove(values, ""), F.lit(1)))

    return rows.select(
        "file",
        "position",
        *[field(n).alias(n) for n in feed.fields],
        F.when(F.col("cells").isNull(), F.col("line")).alias(CORRUPT),
        F.col("name").alias("_file"),
    )


def read_mixed(spark: SparkSession, path: str, feed: Feed) -> DataFrame:
    """Rows of all files of a feed, whatever their layouts: fields, ``_corrupt_record``, ``_file``."""
    lines = quoted_lines(spark, path) if feed.multiline else text_lines(spark, path)
    return parse_lines(lines, feed).drop("file", "position")
