"""From raw documents to training sequences: filter, de-duplicate, clean, mix, pack.

Every stage takes (spark, docs, sf_dir), where ``docs`` is what the stage before kept, and returns
a DataFrame; all but the last return the columns of ``docs``, extra ones included.  A stage's rows
are written as Parquet before the next one reads them.  Null and empty texts, repeated rows and
empty tables are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.llm import mixing, neardup, packing, quality, secret_scan
from shiftlens.llm.shared import importable_on_workers, stored, table, vocabulary_path

LEAST_QUALITY = 0.5
NEAR = neardup.NearParams(words=5, percent=80)
PACK = packing.PackParams(words=250_000, chunk=1_000_000)  # smaller memories: three stages share the workers


def row_and(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns beside the whole row, so that no operator's column meets one of ``docs``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *columns)


def bounded_batches(spark: SparkSession) -> None:
    """Make the package importable on workers, and bound a batch that goes to Python by its bytes: three
    stages run in the same workers, whose memory keeps the size of the largest batch."""
    importable_on_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``LEAST_QUALITY``; learned from all labelled ones."""
    bounded_batches(spark)
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.train(docs, labels, F.lit(False))
    scored = quality.score(row_and(docs, "text"), model, "_score")
    return scored.where(F.col("_score") >= LEAST_QUALITY).select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, and of several
    with that id the one with the smallest digest of its text.

    Rows are linked by a key of doc_id and text, so rows that share a doc_id are compared like any
    others when their texts differ, and so are rows without doc_id, which come last in their group.
    Rows with one doc_id and one text are copies; the one with the smallest hash of the row stays.
    """
    bounded_batches(spark)
    digest = F.md5(F.coalesce("text", F.lit("")))
    key = F.xxhash64("doc_id", digest).alias("key")
    keyed = docs.select("doc_id", digest.alias("digest"), key, "text")
    found = neardup.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"), NEAR)
    found = found.select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = keyed.select("key", "doc_id", "digest").join(found, "key")
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "digest", "key")
    kept = ids.groupBy("component_id").agg(F.min(first).alias("first")).select("first.key")
    # The join and the choice among copies are on one key, so the rows are shuffled once.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key).join(kept, "key", "left_semi")
    return rows.groupBy("key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")


def secret_scanning(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by their kind, n_chars brought up to date."""
    bounded_batches(spark)
    clean = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn with the probabilities that mix sources, languages and topics."""
    columns = ["doc_id", "text", "lang", "source", *[c for c in docs.columns if c == "topic"]]
    return mixing.mix(row_and(docs, *columns)).where("_kept").select("_row.*")


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    bounded_batches(spark)
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"), PACK)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("secret_scanning", secret_scanning),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: Trained models, sketches and a tokenizer have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
