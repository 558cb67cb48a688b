"""Fact tables bucketed by key and partitioned by day, merged without shuffling them.

A row lies in the bucket of its key's hash, in every partition.  An upsert shuffles the updates to
the same buckets and joins each with the bucket that is there already: the target is read where it
lies, and only in the partitions that the updates touch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.session import cut_lineage
from shiftlens.sinks.upsert import check_unique, in_partitions


def write_bucketed(df: DataFrame, table: str, keys: list[str], partition: str, buckets: int) -> None:
    """Write ``df`` as a table bucketed and sorted by ``keys``, partitioned by ``partition``.

    The rows go to their buckets first, so every bucket of a day is one file.
    """
    if partition in keys:
        raise ValueError("the partition column is no bucket column; the other keys are")
    rows = df.repartition(buckets, *keys).sortWithinPartitions(partition, *keys)
    rows.write.mode("overwrite").partitionBy(partition).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)


def merged(target: DataFrame, updates: DataFrame, keys: list[str], partition: str, buckets: int) -> DataFrame:
    """The touched partitions of ``target`` after the upsert; ``updates`` are unique by key and day,
    neither of which may be NULL."""
    touched = in_partitions(target, updates, partition)
    fresh = updates.select(*target.columns).repartition(buckets, *keys)
    dated = [*keys, partition]
    names = fresh.select(*[F.col(c).alias(f"_u_{c}") for c in target.columns], F.lit(True).alias("_new"))
    on = [F.col(c) == F.col(f"_u_{c}") for c in dated]
    joined = touched.hint("merge").join(names, on, "full")
    return joined.select(*[F.when(F.col("_new"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) for c in target.columns])


def upsert_bucketed(spark: SparkSession, table: str, updates: DataFrame, keys: list[str], partition: str, buckets: int) -> None:
    """Upsert into a table of ``write_bucketed`` with the same keys, partition and buckets.

    The merged partitions are written to ``<table>_staging`` and copied from there, bucket by bucket,
    as a table that is read cannot be overwritten; a copy that dies can be run again.
    """
    updates = cut_lineage(updates)
    if not updates.where(" or ".join(f"{c} is null" for c in [*keys, partition])).isEmpty():
        raise ValueError("updates without a key")
    check_unique(updates, [*keys, partition])
    with subset_of_keys(spark):
        rows = merged(spark.table(table), updates, keys, partition, buckets)
        rows = rows.sortWithinPartitions(partition, *keys)
        staging = f"{table}_staging"
        rows.write.mode("overwrite").partitionBy(partition).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(staging)
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        spark.table(staging).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


class subset_of_keys:
    """While it holds, two sides bucketed alike by some of the join's keys meet as they are."""

    NAME = "spark.sql.requireAllClusterKeysForCoPartition"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(self.NAME)
        self.spark.conf.set(self.NAME, "false")

    def __exit__(self, *error):
        self.spark.conf.set(self.NAME, self.before)
