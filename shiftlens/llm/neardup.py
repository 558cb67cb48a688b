"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

1. Every whole text becomes the set of its word shingles (64-bit digests) and a sketch of
   ``bands`` x ``rows`` values by fast similarity sketching: in round i each shingle falls into a
   hashed bin with a value that starts with i, a bin keeps its smallest value, and the rounds stop
   when all bins are filled; from round k on, bin i - k is served by all shingles, so every bin
   fills.  A text of any length costs about k log k values plus one round over its shingles.
2. Texts with equal sets form one class, represented by its smallest doc_id.
3. Representatives that agree on a whole band share a bucket.  Each member is compared with the
   bucket's smallest member only, so a bucket of n texts costs n - 1 comparisons.
4. Where a bucket then still holds more than one component, members of different components meet
   directly, in blocks of bounded size, and only those whose sketches agree about as often as the
   threshold asks (2 bits of each of 1,024 values; the margin is over four standard deviations)
   leave the join as candidates.
5. All comparisons are made on the full sets; components of the confirmed links are found by
   star contraction.

With the sizes below, a pair at the threshold shares no band with a probability under 1e-5.

Null, empty and word-free texts have an empty set and are linked with nothing.  Rows that share a
doc_id count as one document, the one with the largest set (ties: smallest digest).  Rows without
doc_id are left out of the linking and come back with their set size and no component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from shiftlens.llm.components import connected_components
from shiftlens.llm.shared import stored
from shiftlens.session import cut_lineage


@dataclass(frozen=True)
class NearParams:
    """Shingle width, similarity in percent, and the sketch's shape."""

    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    compared: int = 1024  # sketch values of which two bits estimate a pair's likeness
    block: int = 2000  # members of an open bucket that meet in one task

    @property
    def bins(self) -> int:
        return max(self.compared, self.bands * self.rows)

    @property
    def least_agreeing(self) -> int:
        """Two-bit values a pair at the threshold shares, less 4.5 standard deviations."""
        same = 0.25 + 0.75 * self.percent / 100
        return int(self.compared * same - 4.5 * (self.compared * same * (1 - same)) ** 0.5)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Texts to sorted arrays of distinct shingle digests."""

    def __init__(self, words: int, most: int = 400_000) -> None:
        self.words, self.most = words, most
        self.seen: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower() changes A-Z only; bytes.split() cuts at \x20 and \x09-\x0D only.
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        seen = self.seen
        new = set(words).difference(seen)
        if len(seen) + len(new) > self.most:
            seen.clear()
            new = set(words)
        for w in new:
            seen[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(self.words, len(words))
        out = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - width + 1 + k])
        return np.unique(out)


def sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch: ``bins`` values, equal in two sets with their Jaccard likeness."""
    filled = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    at = 0
    while at < 2 * bins:
        step = min(max(1, 2048 // len(shingles)), (bins if at < bins else 2 * bins) - at)
        rounds = np.arange(at, at + step, dtype=np.uint64)[:, None]
        x = mix(shingles[None, :] + mix(rounds + np.uint64(0x5851F42D4C957F2D)))
        value = (rounds << np.uint64(32)) | (x & low)
        if at < bins:
            place = ((x >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
            np.minimum.at(filled, place.ravel().astype(np.int64), value.ravel())
        else:
            own = filled[at - bins : at - bins + step]
            np.minimum(own, value.min(axis=1), out=own)
        at += step
        if not (filled == np.iinfo(np.uint64).max).any():
            break
    return filled


def low_bits(values: np.ndarray, params: NearParams) -> np.ndarray:
    """The lowest two bits of the first ``compared`` values, 32 to a long."""
    pairs = mix(values[: params.compared]).reshape(-1, 32) & np.uint64(3)
    return np.bitwise_or.reduce(pairs << np.arange(0, 64, 2, dtype=np.uint64), axis=1).view(np.int64)


def agreeing(a: str, b: str) -> F.Column:
    """How many two-bit values two columns of ``low_bits`` share."""

    def differing(x):
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    apart = F.aggregate(
        F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n
    )
    return 32 * F.size(a) - apart


def band_keys(values: np.ndarray, params: NearParams) -> np.ndarray:
    rows = values[: params.bands * params.rows].reshape(params.bands, params.rows)
    key = np.arange(params.bands, dtype=np.uint64) + np.uint64(1)
    for k in range(params.rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def sketch_table(docs: DataFrame, params: NearParams) -> DataFrame:
    """(doc_id, n, digest, bands, bits), one row per document; rows without doc_id stay apart."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(params.words)
        for batch in batches:
            n, digest, bands, bits = [], [], [], []
            for text in batch["text"]:
                s = shingler(text)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                values = sketch(s, params.bins) if len(s) else None
                bands.append([] if values is None else band_keys(values, params))
                bits.append([] if values is None else low_bits(values, params))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": n, "digest": digest, "bands": bands, "bits": bits})

    found = docs.mapInPandas(rows, "doc_id long, n long, digest binary, bands array<long>, bits array<long>").withColumn(
        "alone", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    )
    one = Window.partitionBy("doc_id", "alone").orderBy(F.desc("n"), "digest")
    return stored(found.withColumn("turn", F.row_number().over(one)).where("turn = 1").drop("turn", "alone"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, params: NearParams) -> DataFrame:
    """(id, shingles) of the wanted (id, digest)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(params.words)
        for batch in batches:
            ids, sets = [], []
            for doc_id, digest, text in zip(batch["id"], batch["digest"], batch["text"]):
                s = shingler(text)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == bytes(digest):
                    ids.append(doc_id)
                    sets.append(s.view(np.int64))
            yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "shingles": pd.Series(sets, dtype=object)})

    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id")
    return stored(
        texts.select("id", "digest", "text").mapInPandas(rows, "id long, shingles array<long>").dropDuplicates(["id"])
    )


def confirmed(pairs: DataFrame, sets: DataFrame, params: NearParams) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("left") + F.size("right")).alias("sum"))
        .where(100 * F.col("both") >= params.percent * (F.col("sum") - F.col("both")))
        .select("a", "b")
    )


def close_sizes(n1, n2, percent: int):
    return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)


def star_pairs(members: DataFrame, params: NearParams) -> DataFrame:
    """Pairs (a, b) of each bucket's smallest member with its others; members: (key, id, n)."""
    lead = members.groupBy("key").agg(
        F.min(F.struct("id", "n")).alias("lead"), F.max("id").alias("last")
    )
    lead = lead.where(F.col("lead.id") < F.col("last")).select(
        "key", F.col("lead.id").alias("a"), F.col("lead.n").alias("na")
    )
    return (
        members.join(lead, "key")
        .where(F.col("id") > F.col("a"))
        .where(close_sizes(F.col("n"), F.col("na"), params.percent))
        .select("a", F.col("id").alias("b"))
        .distinct()
    )


def open_buckets(members: DataFrame) -> DataFrame:
    """(key, size) of the buckets with members of more than one component."""
    return (
        members.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("id").alias("size"))
        .where(F.col("low") < F.col("high"))
        .select("key", "size")
    )


def residual_pairs(members: DataFrame, sketches: DataFrame, params: NearParams) -> DataFrame:
    """Candidate pairs of different components within a bucket.

    ``members``: (key, id, n, component).  A pair that shares several bands comes from the
    smallest of them only.
    """
    sizes = open_buckets(members).select("key", F.ceil(F.col("size") / params.block).cast("int").alias("blocks"))
    near = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    near = near.join(sketches.select(F.col("doc_id").alias("id"), "bands", "bits"), "id")

    def side(block, x: str) -> DataFrame:
        names = {"id": x, "n": f"n{x}", "component": f"c{x}", "bands": f"bands{x}", "bits": f"bits{x}"}
        return near.select("key", block.alias("block"), *[F.col(k).alias(v) for k, v in names.items()])

    left = side(F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "a")
    right = side(F.col("block"), "b")
    pair = (
        (left["key"] == right["key"])
        & (left["block"] == right["block"])
        & (F.col("a") < F.col("b"))
        & (F.col("ca") != F.col("cb"))
        & close_sizes(F.col("na"), F.col("nb"), params.percent)
        & (agreeing("bitsa", "bitsb") >= params.least_agreeing)
        & (F.array_min(F.array_intersect("bandsa", "bandsb")) == left["key"])
    )
    return left.join(right, pair).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document; ``docs`` has doc_id and text."""
    docs = docs.select("doc_id", "text")
    sketches = sketch_table(docs, params)
    linked = sketches.where("n > 0 and doc_id is not null")
    classes = linked.groupBy("digest").agg(F.min("doc_id").alias("id"))
    reps = linked.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    members = cut_lineage(
        shared_buckets(reps.select(F.col("doc_id").alias("id"), "n", F.explode("bands").alias("key")))
    )
    wanted = sketches.select(F.col("doc_id").alias("id"), "digest").join(
        members.select("id").distinct(), "id"
    )
    sets = shingle_sets(docs, wanted, params)
    links = cut_lineage(confirmed(star_pairs(members, params), sets, params))
    first = connected_components(links)
    labelled = with_component(members, first)
    more = cut_lineage(confirmed(residual_pairs(labelled, sketches, params), sets, params))
    found = connected_components(links.union(more))
    by_class = with_component(classes, found).select("digest", "component")
    return (
        sketches.select("doc_id", "n", "digest")
        .join(by_class, "digest", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
    )


def shared_buckets(rows: DataFrame) -> DataFrame:
    """The rows of buckets with more than one member."""
    sizes = rows.groupBy("key").agg(F.count("id").alias("size")).where(F.col("size") > 1)
    return rows.join(sizes.select("key"), "key", "left_semi")


def with_component(rows: DataFrame, components: DataFrame) -> DataFrame:
    """``rows`` with the component of their ``id``; an id without links is its own."""
    return rows.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
