"""JSON results and configuration backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def set_config(config: DataFrame, changes: DataFrame) -> DataFrame:
    """Config rows after setting some keys."""
    from shiftlens.sinks.upsert import upsert

    return upsert(config, changes, ["key"])


def backup_config(config: DataFrame, path: str) -> None:
    write_json(config, path)


def restore_config(spark: SparkSession, path: str, config: DataFrame) -> DataFrame:
    """The config with every key of the backup set to its backed-up value."""
    saved = spark.read.schema(config.schema).json(path)
    return set_config(config, saved)
