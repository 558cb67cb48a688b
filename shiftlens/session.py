"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Options that make the plans below behave at scale: AQE coalesces small shuffle
# partitions, splits skewed join partitions (also when that costs one more shuffle)
# and switches to a broadcast join only after it has measured the build side.
SCALE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Checkpoints go once nothing refers to them; else every lineage cut stays on the shared store.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    app: str = "shiftlens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with UTC, ANSI and AQE on.

    ``shuffle_partitions`` is the upper bound AQE coalesces from: leave it unset on
    a cluster whose defaults are sized already, set it to a few times the core count
    otherwise (for 100 TB, enough that one partition stays near 200 MB).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone: calendar days in every operator are UTC days."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints and intermediate tables."""
    return spark.conf.get("spark.checkpoint.dir", None)


def shared_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder, which all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session without that setting
    gets a temporary folder; elsewhere the setting is required, since a folder of one machine would
    be lost with it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = checkpoint_root(spark)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="shiftlens-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def working_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for tables that are written on the way."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Write ``df`` to the shared folder as a reliable checkpoint and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
