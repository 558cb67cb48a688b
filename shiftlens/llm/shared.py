"""Helpers of the training-data operators."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.session import cut_lineage


def importable_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it.

    Matters for sessions whose workers see the same path (local ones, shared installations); a
    cluster that gets the package by --py-files does not need it.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table; everything else is pruned at the scan."""
    importable_on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share; a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        cut_lineage(spark.range(1))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    Columnar and compressed, so large intermediate tables cost less disk than a checkpoint,
    later readers prune columns, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str | F.Column = "text") -> F.Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def remainder(column: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n; a null id counts as remainder 0 of nothing: NULL."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def vocabulary_path(name: str) -> str:
    """Default place of a public vocabulary file; callers may pass their own path."""
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))
