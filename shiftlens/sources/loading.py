"""One load of a feed with its counters, taken while the data passes.

The text is parsed once, into a staging table; the counters of what was read, rejected and stored are
observed on the rows as they are written, so no count reads anything again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F

from shiftlens.sources.feeds import CORRUPT, split_corrupt
from shiftlens.sources.jobs import JOBS, Dimensions, FeedResult
from shiftlens.sinks.upsert import last_per_key


@dataclass
class Load:
    """``rows``: one per key, ready to upsert; ``rejects`` with their reason; ``broken`` lines; the
    ``result`` of the job (keys, created dimension rows); ``counts`` by outcome."""

    rows: DataFrame
    rejects: DataFrame
    broken: DataFrame
    result: FeedResult
    counts: dict[str, int]


def _count_if(condition) -> F.Column:
    return F.count(F.when(condition, F.lit(1)))


def load_feed(
    feed: str, raw: DataFrame, dims: Dimensions, staging: str, stored: DataFrame | None = None, order: list[str] | None = None
) -> Load:
    """Parse, normalise and count one load.

    ``raw`` has the fields of the feed, with ``_corrupt_record`` where lines may be broken; ``stored``
    are the rows stored before, by which a key counts as updated; of the rows of one key the greatest
    by ``order`` (by default, by all other columns) is the one to store.
    """
    spark = raw.sparkSession
    if CORRUPT not in raw.columns:
        raw = raw.withColumn(CORRUPT, F.lit(None).cast("string"))
    if "_file" not in raw.columns:
        raw = raw.withColumn("_file", F.lit(None).cast("string"))
    source, rejected, kept = Observation(), Observation(), Observation()
    raw.observe(
        source, F.count(F.lit(1)).alias("processed"), _count_if(F.col(CORRUPT).isNotNull()).alias("corrupt")
    ).write.mode("overwrite").parquet(f"{staging}/fields")
    good, broken = split_corrupt(spark.read.schema(raw.schema).parquet(f"{staging}/fields"))
    result = JOBS[feed](good.drop("_file"), dims)
    result.rejects.observe(rejected, F.count(F.lit(1)).alias("rejected")).write.mode("overwrite").parquet(f"{staging}/rejects")
    keys = result.keys
    others = order or [c for c in result.rows.columns if c not in keys]
    single = last_per_key(result.rows.withColumn("_n", F.lit(1)), keys, others).drop("_n")
    copies = result.rows.groupBy(*[F.col(k).alias(f"_c_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_copies"))
    tagged = single.join(copies, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys]).drop(*[f"_c_{k}" for k in keys])
    if stored is None:
        tagged = tagged.withColumn("_known", F.lit(False))
    else:
        known = stored.select(*[F.col(k).alias(f"_s_{k}") for k in keys]).distinct().withColumn("_old", F.lit(True))
        tagged = tagged.join(known, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys], "left")
        tagged = tagged.withColumn("_known", F.coalesce("_old", F.lit(False))).drop("_old", *[f"_s_{k}" for k in keys])
    tagged.observe(
        kept,
        _count_if(~F.col("_known")).alias("inserted"),
        _count_if(F.col("_known")).alias("updated"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"),
    ).write.mode("overwrite").parquet(f"{staging}/rows")
    rows = spark.read.schema(tagged.schema).parquet(f"{staging}/rows").drop("_known", "_copies")
    rejects = spark.read.schema(result.rejects.schema).parquet(f"{staging}/rejects")
    return Load(rows, rejects, broken, result, {**source.get, **rejected.get, **kept.get})


def counts_frame(feed: str, load: Load) -> DataFrame:
    """(feed, outcome, rows): one row per counter of a load."""
    spark = load.rows.sparkSession
    return spark.createDataFrame([(feed, k, int(v)) for k, v in load.counts.items()], "feed string, outcome string, rows long")
