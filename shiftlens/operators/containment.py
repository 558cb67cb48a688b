"""Which texts contain which patterns, by equi joins of pieces of the texts.

A text that contains a pattern has, somewhere, the pattern's first q characters; from there on, a
piece as long as the pattern equals it.  So the places of every text are looked up among the heads
of the patterns, and at those that are found one piece is cut for each length that patterns with
that head have.  Pieces meet patterns by equality: the rows grow with the texts' characters, times
the lengths of patterns that begin alike, and never with patterns times texts that merely share a
gram.  Patterns shorter than q are heads themselves, of their own length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def containments(patterns: DataFrame, texts: DataFrame, q: int = 3) -> DataFrame:
    """(pattern, text): every distinct pattern with every distinct text that contains it.

    ``patterns`` has a column pattern, ``texts`` a column text; NULL and empty ones find nothing.
    """
    wanted = patterns.select("pattern").where("pattern <> ''").distinct().withColumn("length", F.length("pattern"))
    wanted = wanted.withColumn("size", F.least("length", F.lit(q)))
    heads = (
        wanted.select("size", "length", F.expr("substring(pattern, 1, size)").alias("head"))
        .groupBy("head")
        .agg(F.first("size").alias("size"), F.collect_set("length").alias("lengths"))
    )
    sizes = heads.agg(F.sort_array(F.collect_set("size")).alias("sizes")).scalar()  # q numbers at most
    held = texts.select("text").where("text <> ''").distinct().withColumn("key", F.xxhash64("text"))
    places = (
        held.select("text", "key", F.explode(sizes).alias("size"))
        .where("length(text) >= size")
        .select("text", "key", "size", F.explode(F.expr("sequence(1, length(text) - size + 1)")).alias("at"))
        .select("key", "at", F.expr("substring(text, at, size)").alias("head"))
    )
    cut = places.join(heads.select("head", "lengths"), "head").select("key", "at", F.explode("lengths").alias("length"))
    # Two texts with one key only add pieces to each other that they may hold or not, each cut from itself.
    pieces = cut.join(held, "key").select("text", F.expr("substring(text, at, length)").alias("pattern")).distinct()
    return pieces.join(wanted.select("pattern"), "pattern").select("pattern", "text")
