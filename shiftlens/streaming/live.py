"""Feeds that arrive while the tables are in use: Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from shiftlens.operators.dedup import activity_hash
from shiftlens.operators.kpi import _decimal_micro
from shiftlens.functions.numeric import micro_to_decimal
from shiftlens.session import cut_lineage
from shiftlens.sinks.upsert import last_per_key, upsert_table
from shiftlens.sources.feeds import CORRUPT, FEEDS, _columns_of, raw_text, split_corrupt, to_fields
from shiftlens.sources.jobs import JOBS, Dimensions, FeedResult
from shiftlens.sources.lines import parse_lines
from shiftlens.streaming.incremental import DailyTables


def stream_feed(
    spark: SparkSession, directory: str, feed: str, header: str, sep: str, max_files: int = 1000
) -> DataFrame:
    """Files of a drop folder as they come, with the engine fields of the feed."""
    columns = _columns_of(header, sep)
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in columns] + [T.StructField(CORRUPT, T.StringType())]
    )
    raw = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("maxFilesPerTrigger", max_files)
        .option("multiLine", FEEDS[feed].multiline)
        .csv(directory)
        .withColumn("_file", F.col("_metadata.file_name"))
    )
    return to_fields(raw, FEEDS[feed])


# What a created row holds in columns that no feed fills.
DEFAULTS = {"active": True}


def store_created(result: FeedResult, dimensions: dict[str, str]) -> bool:
    """Append the rows a batch creates to their dimension tables; whether there were any."""
    some = False
    for name, path in dimensions.items():
        if name not in result.created:
            continue
        stored = result.created[name].sparkSession.read.parquet(path)
        new = cut_lineage(result.created[name])  # it reads the table it is appended to
        if new.isEmpty():
            continue
        some = True
        new.select(
            *[
                (F.col(f.name) if f.name in new.columns else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name)
                for f in stored.schema
            ]
        ).write.mode("append").parquet(path)
    return some


def upsert_stream(
    rows: DataFrame,
    path: str,
    staging: str,
    keys: list[str],
    order: list[str],
    partition: str,
    checkpoint: str,
    prepare=None,
    dimensions: dict[str, str] | None = None,
) -> DataStreamWriter:
    """Upsert every micro batch into a table.  ``prepare`` turns a batch of feed rows into
    table rows, or into a ``FeedResult``, reading the dimensions as they are then.

    ``dimensions`` names the table paths of dimensions a ``FeedResult`` may create rows for.
    Those are stored first and the batch is prepared again, so facts get the stored ids and
    the next batch goes on from there.  A batch that is run again after a failure changes
    nothing: its names are known by then, and the upsert is by key."""

    def write(batch: DataFrame, _batch_id: int) -> None:
        ready = prepare(batch) if prepare is not None else batch
        if isinstance(ready, FeedResult):
            if store_created(ready, dimensions or {}):
                ready = prepare(batch)
            ready = ready.rows
        upsert_table(last_per_key(ready, keys, order), path, staging, keys, partition)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_lines(spark: SparkSession, directory: str, feed: str, max_files: int = 1000) -> DataFrame:
    """Lines of a feed's files in a drop folder as the files come, whatever their layouts."""
    spec = FEEDS[feed]
    if spec.multiline:
        raise ValueError(f"{feed}: its cells may hold line breaks; use stream_feed with a header")
    return (
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", spec.pattern.replace(".csv", "*.csv"))
        .text(directory)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_name").alias("name"),
            F.col("_metadata.file_block_start").alias("block"),
            "value",
        )
    )


def batch_rows(batch: DataFrame, feed: str) -> DataFrame:
    """The rows of a batch of lines; a file lies in one batch, so its header is there too."""
    lines = batch.select(
        "file",
        "name",
        F.struct("block", F.monotonically_increasing_id().alias("row")).alias("position"),
        raw_text(F.col("value")).alias("line"),
    )
    return parse_lines(cut_lineage(lines), FEEDS[feed]).drop("file", "position")


def maintain(
    rows: DataFrame,
    feed: str,
    tables: Callable[[], DailyTables],
    dimensions: Callable[[], Dimensions],
    paths: dict[str, str],
    checkpoint: str,
    quarantine: str | None = None,
    parse: Callable[[DataFrame], DataFrame] | None = None,
) -> DataStreamWriter:
    """From arriving rows of a feed to facts, KPI rows and anomalies, batch by batch.

    ``tables`` and ``dimensions`` open the tables as they are at the moment, ``paths`` names those of
    the dimensions, into which people, clients and vehicles that a batch creates go first.  Broken
    lines go to ``quarantine``, by batch, so a batch run again replaces its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fields = parse(batch) if parse is not None else batch
        good, bad = split_corrupt(cut_lineage(fields))
        if quarantine is not None:
            bad.write.mode("overwrite").parquet(f"{quarantine}/feed={feed}/batch={batch_id}")
        result = JOBS[feed](good, dimensions())
        if store_created(result, paths):
            result = JOBS[feed](good, dimensions())
        tables().apply({feed: result.rows}, {feed: result.keys})

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


# The feeds that facts come from; projects are a dimension.
FACT_FEEDS = ["timesheets", "absences", "activities", "vehicle_log", "remote_sessions"]


def process_folder(
    spark: SparkSession,
    directory: str,
    tables: Callable[[], DailyTables],
    dimensions: Callable[[], Dimensions],
    paths: dict[str, str],
    checkpoint: str,
    quarantine: str | None = None,
    calendar_header: tuple[str, str] | None = None,
) -> None:
    """Take in whatever has arrived in a drop folder since the last call: every feed is parsed,
    normalised and stored, and the KPI rows and anomalies of the days it touches are made anew.

    One feed after the other, as all write the same tables; what a stream has processed is in its
    checkpoint.  Appointments need ``calendar_header`` (header line and separator), since their cells
    may hold line breaks.
    """
    for feed in FACT_FEEDS:
        lines = stream_lines(spark, directory, feed)
        query = maintain(
            lines, feed, tables, dimensions, paths, f"{checkpoint}/{feed}", quarantine,
            parse=lambda batch, feed=feed: batch_rows(batch, feed),
        ).trigger(availableNow=True).start()
        query.awaitTermination()
    if calendar_header is not None:
        rows = stream_feed(spark, directory, "calendar", *calendar_header)
        query = maintain(rows, "calendar", tables, dimensions, paths, f"{checkpoint}/calendar", quarantine)
        query.trigger(availableNow=True).start().awaitTermination()


def live_hours(timesheets: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Hours and punches per employee and day, updated as punches come.  State of a day is
    dropped once the watermark has passed it; later rows are ignored."""
    return (
        timesheets.withWatermark("start_ts", lateness)
        .groupBy("employee_id", F.window("start_ts", "1 day").alias("w"))
        .agg(F.sum(_decimal_micro(F.col("hours"))).alias("micro"), F.count(F.lit(1)).alias("punches"))
        .select(
            "employee_id",
            F.to_date("w.start").alias("work_date"),
            micro_to_decimal(F.col("micro")).alias("timesheet_hours"),
            "punches",
        )
    )


def first_occurrences(activities: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Activities without the copies of one already seen within the watermark."""
    return (
        activities.withColumn("activity_hash", activity_hash())
        .withWatermark("start_ts", lateness)
        .dropDuplicatesWithinWatermark(["activity_hash"])
    )
