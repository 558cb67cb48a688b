"""Import logs: lines of ``[time] [session] [LEVEL] [Memory: ..] [Time: ..] message``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# The line format, the levels and the text that opens a session.
LINE = r"^\[([^\]]+)\] \[([^\]]+)\] \[([A-Z]+)\] \[Memory: ([0-9.]+)MB\] \[Time: ([0-9.]+)s\] (.*)$"
LEVELS = ["ERROR", "WARNING", "INFO", "DEBUG"]
SESSION_START = "=== Avvio sessione import"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), "value")


def parse_log(lines: DataFrame) -> DataFrame:
    """Time, session, level, memory, elapsed seconds and message of every line."""

    def part(i: int):
        return F.regexp_extract("value", LINE, i)

    return lines.select(
        "file_name",
        F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("logged_at"),
        part(2).alias("session_id"),
        part(3).alias("level"),
        part(4).try_cast("double").alias("memory_mb"),
        part(5).try_cast("double").alias("elapsed_s"),
        part(6).alias("message"),
        "value",
    )


def log_stats(lines: DataFrame) -> DataFrame:
    """Lines in total and per level, and sessions, for each log file."""
    v = F.col("value")

    def times(text: str):
        return F.count(F.when(v.contains(text), F.lit(1)))

    return lines.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("total_lines"),
        *[times(f"[{level}]").alias(f"{level.lower()}_count") for level in LEVELS],
        times(SESSION_START).alias("sessions"),
    )


def recent_lines(lines: DataFrame, limit: int = 100) -> DataFrame:
    """The last lines by time; a top-k that keeps ``limit`` rows per task, never a full sort."""
    return (
        parse_log(lines)
        .orderBy(F.desc("logged_at"), F.desc("session_id"), F.desc("elapsed_s"), F.desc("value"))
        .limit(limit)
    )


def log_sessions(lines: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of logs that carry no session id: lines of a file at most ``gap`` apart.

    Per session: first and last time, lines, errors, highest memory, and the longest and the total
    time between one instant of the log and the next.  Lines are first added up per file and second,
    which bounds what a crowded file brings to the sessions.
    """
    instants = (
        parse_log(lines)
        .where("logged_at is not null")
        .groupBy("file_name", "logged_at")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.count(F.when(F.col("level") == "ERROR", 1)).alias("errors"),
            F.max("memory_mb").alias("memory_mb"),
        )
    )
    # The step to an instant belongs to its session unless it is the first one there.
    before = F.lag("logged_at").over(Window.partitionBy("file_name").orderBy("logged_at"))
    stepped = instants.withColumn("before", before)
    step = F.timestamp_diff("SECOND", F.col("before"), F.col("logged_at"))
    opens = F.col("before").isNull() | (F.col("logged_at") > F.col("before") + F.expr(f"interval '{gap}'"))
    stepped = stepped.withColumn("step", F.when(~opens, step))
    return (
        stepped.groupBy("file_name", F.session_window("logged_at", gap).alias("w"))
        .agg(
            F.min("logged_at").alias("first_at"),
            F.max("logged_at").alias("last_at"),
            F.sum("lines").alias("lines"),
            F.sum("errors").alias("errors"),
            F.max("memory_mb").alias("memory_mb"),
            F.coalesce(F.max("step"), F.lit(0)).alias("longest_step_s"),
            F.coalesce(F.sum("step"), F.lit(0)).alias("total_s"),
        )
        .drop("w")
    )
