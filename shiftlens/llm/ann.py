"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Vectors get one extra coordinate that makes all of them equally long (so that the largest inner
product becomes the smallest angle) and are padded to a power of two.  A pseudo-rotation flips
signs and applies a fast Hadamard transform, three times; the signed axis nearest to the result is
the hash.  A table's code joins two such hashes, the second over fewer axes.  A query looks up, in
every table, the ``probes`` codes with the largest summed projections (and those as large as the
last); the union of these buckets are its candidates, and their inner products with the original
vectors, in double precision, decide.

The buckets of a query hold a large share of all rows, so they are not gone through one by one:
matrix products in single precision find the rows with the largest inner products, and of these
the ones in a probed bucket are kept, until what is left cannot be among the best ``k`` whatever
the rounding.  Queries for which that is not so go through their buckets.  Both ways give the same
rows.  The products are still all queries by all rows.

All rows are indexed.  They are dealt into blocks that fit a task's memory; a block keeps its
vectors once and answers every query, so vectors are never replicated and no candidate pair ever
leaves a task: per query and block only the best ``k`` do.  What a query looks up is worked out
once, before it is sent to the blocks.  Which rows are candidates does not depend on the blocks.

Vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part, nor do rows without vec_id.  Repeated rows of one vec_id count once (the smallest
vector).  Ties go to the smaller vec_id.  With fewer than ``k`` candidates a query has fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLOCK_NUMBERS = 12_800_000  # 200,000 vectors of 64 numbers
SAMPLED, TILE, AT_ONCE = 4096, 2048, 256  # rows that tell where to look, rows and queries of a product


@dataclass(frozen=True)
class AnnParams:
    k: int = 20
    tables: int = 20
    axes: tuple[int, int] = (64, 8)  # of the first and the second hash
    probes: int = 64  # codes looked up per table, in tables of any size
    seed: int = 3

    @property
    def codes(self) -> int:
        return 4 * self.axes[0] * self.axes[1]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def signs(params: AnnParams, d: int) -> np.ndarray:
    """Sign flips, (tables, hashes, rounds, d)."""
    return np.random.default_rng(params.seed).choice([-1.0, 1.0], (params.tables, 2, 3, d))


def lengths(x: np.ndarray) -> np.ndarray:
    """Length of each row, without overflow or underflow on the way."""
    most = np.abs(x).max(axis=1, keepdims=True)
    return most[:, 0] * np.sqrt(((x / most) ** 2).sum(axis=1))


def ones(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few true ones, eight at a time."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    at = np.flatnonzero(flat[:whole].view(np.uint64))
    part, place = np.nonzero(flat[:whole].reshape(-1, 8)[at])
    return np.r_[at[part] * 8 + place, whole + np.flatnonzero(flat[whole:])]


class Hashes:
    """The pseudo-rotations of all tables, as one matrix over the vectors with their extra coordinate."""

    def __init__(self, d: int, params: AnnParams) -> None:
        self.params = params
        width = 1 << int(np.ceil(np.log2(d + 1)))
        self.axes = [min(a, width) for a in params.axes]
        turned = []
        for flips in signs(params, width):
            for f, axes in zip(flips, self.axes):
                x = np.eye(d + 1, width)
                for flip in f:
                    x = hadamard(x * flip)
                turned.append(x[:, :axes])
        self.matrix = np.concatenate(turned, axis=1)

    def projections(self, x: np.ndarray, extra: np.ndarray | None = None) -> list[np.ndarray]:
        """Signed-axis projections of both hashes, each (rows, tables, 2 * axes).

        They are rounded: projections that are equal but for the product's last bits tie.
        """
        found = x @ self.matrix[:-1]
        if extra is not None:
            found += extra[:, None] * self.matrix[-1]
        found = np.round(found, 12).reshape(len(x), self.params.tables, sum(self.axes))
        first, second = found[:, :, : self.axes[0]], found[:, :, self.axes[0] :]
        return [np.concatenate([p, -p], axis=2) for p in (first, second)]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) codes of vectors at most 1 long."""
        out = np.empty((len(x), self.params.tables), dtype=np.min_scalar_type(self.params.codes))
        for at in range(0, len(x), 128):
            part = x[at : at + 128]
            a, b = self.projections(part, np.sqrt(np.maximum(1 - (part * part).sum(axis=1), 0)))
            out[at : at + 128] = a.argmax(axis=2) * b.shape[2] + b.argmax(axis=2)
        return out

    def least(self, unit: np.ndarray) -> np.ndarray:
        """(queries, tables): the least summed projections of the codes that are looked up."""
        out = np.empty((len(unit), self.params.tables))
        for at in range(0, len(unit), 64):
            a, b = (-np.sort(-p, axis=2) for p in self.projections(unit[at : at + 64]))
            most = min(self.params.probes, a.shape[2] * b.shape[2])
            # The i-th with the j-th largest has i * j sums at least as large, itself with them.
            i, j = np.nonzero(np.outer(np.arange(1, a.shape[2] + 1), np.arange(1, b.shape[2] + 1)) <= most)
            out[at : at + 64] = np.partition(a[:, :, i] + b[:, :, j], len(i) - most, axis=2)[:, :, len(i) - most]
        return out - 1e-9


class BlockIndex:
    """The vectors of one block and their codes in all tables."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float, hashes: Hashes) -> None:
        params = hashes.params
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        # Of equal vectors only the k + 1 with the smallest ids can be among the best k of any query.
        x = x[few := self.first_copies(x, params.k + 1)]
        self.ids, self.x, self.params, self.hashes = ids[few], x, params, hashes
        self.codes = np.concatenate([hashes.codes(x[at : at + TILE] / np.float64(longest)) for at in range(0, len(x), TILE)])
        self.by_table = np.ascontiguousarray(self.codes.T)
        self.longest = max(lengths(x[at : at + TILE].astype(np.float64)).max() for at in range(0, len(x), TILE))
        self.small = np.empty(x.shape, dtype=np.float32)
        for at in range(0, len(x), TILE):
            self.small[at : at + TILE] = x[at : at + TILE] / self.longest
        self.sample = self.small[:: max(1, len(x) // SAMPLED)].copy()
        # More than a product of the small vectors can be off by, as a share of both lengths.
        self.off = (x.shape[1] + 8) * 2.0**-24

    @staticmethod
    def first_copies(x: np.ndarray, most: int) -> np.ndarray:
        """Places of the rows but for those with ``most`` equal rows before them."""
        words = np.ascontiguousarray(x).view(np.uint64 if x.itemsize == 8 else np.uint32)
        odd = np.random.default_rng(1).integers(0, 1 << 63, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        digest = np.zeros(len(x), dtype=np.uint64)
        for column, factor in zip(words.T, odd):
            digest += column.astype(np.uint64) * factor
        order = np.argsort(digest, kind="stable")
        starts = np.flatnonzero(np.r_[True, digest[order[1:]] != digest[order[:-1]]])
        sizes = np.diff(np.r_[starts, len(x)])
        first = np.repeat(starts, sizes)
        late = np.flatnonzero(np.arange(len(x)) - first >= most)
        late = late[(x[order[late]] == x[order[first[late]]]).all(axis=1)]
        return np.setdiff1d(np.arange(len(x)), order[late])

    def probed(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
        """(queries, rows of each): whether the row stands in a bucket that the query looks up."""
        first, second = np.divmod(self.codes[rows], self.codes.dtype.type(b.shape[2]))  # (queries, rows, tables)
        place = (np.arange(len(rows))[:, None] * a.shape[1] + np.arange(a.shape[1]))[:, None, :]
        summed = a.ravel()[place * a.shape[2] + first] + b.ravel()[place * b.shape[2] + second]
        return (summed >= least[:, None, :]).any(axis=2)

    def largest(self, unit: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query whether its ``most`` rows with the largest products were found, these, and the least product."""
        n, m = len(self.small), len(unit)
        if n <= most:
            return np.ones(m, dtype=bool), np.tile(np.arange(n), (m, 1)), np.full(m, -np.inf)
        at = len(self.sample) - min(len(self.sample), most if len(self.sample) == n else 5 + -(-3 * most * len(self.sample) // (2 * n)))
        floor = np.partition(unit @ self.sample.T, at, axis=1)[:, at]
        floor -= np.float32(self.off)  # another product of the same row may be less
        parts = []
        products, over = np.empty((m, TILE), dtype=np.float32), np.empty((m, TILE), dtype=bool)
        for start in range(0, n, TILE):
            tile = self.small[start : start + TILE].T
            if tile.shape[1] < TILE:
                products, over = np.empty((m, tile.shape[1]), dtype=np.float32), np.empty((m, tile.shape[1]), dtype=bool)
            product = np.matmul(unit, tile, out=products)
            hit = ones(np.greater_equal(product, floor[:, None], out=over))
            asker, row = np.divmod(hit, product.shape[1])
            parts.append((asker, row + start, product.ravel()[hit]))
        asker, row, product = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(asker * 4.0 - product)
        counts = np.bincount(asker, minlength=m)
        found = counts >= most
        own = order[(np.cumsum(counts) - counts)[found][:, None] + np.arange(most)]
        rows, level = np.zeros((m, most), dtype=np.int64), np.full(m, np.inf)
        rows[found], level[found] = np.sort(row[own], axis=1), product[own[:, -1]]
        return found, rows, level

    def search(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query the best k candidates: (ids, scores), best first, ties to the smaller id."""
        k = self.params.k
        for at in range(0, len(queries), AT_ONCE):
            own, q, low = (p[at : at + AT_ONCE] for p in (query_ids, queries, least))
            long = lengths(q)
            unit = q / long[:, None]
            a, b = self.hashes.projections(unit)
            small = unit.astype(np.float32)
            found, rows, level = self.largest(small, 3 * k + 4)
            score = (self.x[rows] * q[:, None, :]).sum(axis=2)
            score[~self.probed(rows, a, b, low) | (self.ids[rows] == own[:, None])] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, rows = np.take_along_axis(score, best, axis=1), np.take_along_axis(rows, best, axis=1)
            if len(self.ids) > 3 * k + 4:
                found &= score[:, -1] / (long * self.longest) > level + self.off
            for j in range(len(q)):
                if found[j]:
                    kept = score[j] > -np.inf
                    yield self.ids[rows[j][kept]], score[j][kept]
                else:
                    yield self.through_buckets(own[j], q[j], small[j], a[j], b[j], low[j])

    def through_buckets(self, query_id, query: np.ndarray, small: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray):
        looked_up = ((a[:, :, None] + b[:, None, :]).reshape(len(a), -1)) >= least[:, None]
        seen = np.zeros(len(self.ids), dtype=bool)
        for own, code in zip(looked_up, self.by_table):
            seen |= own[code]
        found = np.flatnonzero(seen & (self.ids != query_id))
        if len(found) > self.params.k:
            product = (self.small @ small)[found]
            # Whatever may be among the best stays.
            last = np.partition(product, len(product) - self.params.k)[len(product) - self.params.k]
            found = found[product >= last - 2 * self.off]
        # Equal vectors get equal scores this way; ids are sorted, so ties go to the smaller one.
        score = (self.x[found] * query).sum(axis=1)
        best = np.argsort(-score, kind="stable")[: self.params.k]
        return self.ids[found[best]], score[best]


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v) of the rows that take part; v is an array of doubles, or of floats if it comes so."""
    v = F.col("v")

    def finite(x: Column) -> Column:
        return F.abs(x) < F.lit(float("inf"))  # NaN counts as larger, null makes the condition null

    kind = "array<float>" if dict(vectors.dtypes)[column] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_column).alias("id"), F.col(column).cast(kind).alias("v"))
    rows = rows.where(
        F.col("id").isNotNull() & (F.size("v") > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    )
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a column of arrays of ``d`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def arrays(x: np.ndarray) -> pa.Array:
    """A column of arrays from the rows of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def block_count(spark: SparkSession, n: int, d: int) -> int:
    """Blocks that fit a task, and one for each core at least; every query is sent to each of them."""
    cores = spark.sparkContext.defaultParallelism
    return max(-(-n * d // BLOCK_NUMBERS), min(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    column: str = "embedding",
    params: AnnParams = AnnParams(),
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other vectors for each query row.

    ``is_query`` is a condition over ``id``, the row's id.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, column)
    stats = rows.agg(
        F.mode(F.size("v")).alias("d"),
        F.count("id").alias("n"),
        F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).alias("longest"),
    ).first()
    d, n, longest = stats.d or 1, stats.n, stats.longest or 1.0
    rows = rows.where(F.size("v") == d)
    blocks = block_count(spark, n, d)
    data = rows.select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(False).alias("asks"), "id", "v", F.lit(None).cast("array<double>").alias("least")
    )

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(d, params)
        for batch in batches:
            x = matrix(batch.column("v"), d).astype(np.float64)
            least = hashes.least(x / lengths(x)[:, None])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), arrays(least)], ["id", "v", "least"])

    kind = dict(rows.dtypes)["v"]
    asked = (
        rows.where(is_query)
        .select(F.col("id").cast("long").alias("id"), "v")
        .mapInArrow(looked_up, f"id long, v {kind}, least array<double>")
        .select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("asks"), "id", "v", "least"
        )
    )

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(d, params)
        block, index, ids, parts = None, None, [], []
        for batch in batches:
            number, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "asks"))
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(number)]):
                if start == end:
                    continue
                if number[start] != block:
                    block, index, ids, parts = number[start], None, [], []
                run = batch.slice(start, end - start)
                own, x = run.column("id").to_numpy(zero_copy_only=False), matrix(run.column("v"), d)
                if not asks[start]:
                    ids.append(own)
                    parts.append(x)
                    continue
                if index is None:
                    if not ids:
                        continue
                    index = BlockIndex(np.concatenate(ids), np.concatenate(parts), longest, hashes)
                    ids, parts = [], []
                least = matrix(run.column("least"), params.tables)
                found = list(index.search(own, x.astype(np.float64), least))
                offsets = np.r_[0, np.cumsum([len(f) for f, _ in found])].astype(np.int32)
                hits = pa.StructArray.from_arrays(
                    [pa.array(-np.concatenate([s for _, s in found])), pa.array(np.concatenate([f for f, _ in found]))], ["key", "id"]
                )
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(pa.array(offsets), hits)], ["query_id", "hits"])

    local = (
        data.withColumn("id", F.col("id").cast("long"))
        .unionByName(asked)
        .repartitionById(blocks, F.col("block").cast("int"))
        .sortWithinPartitions("block", "asks")
        .mapInArrow(answered, "query_id long, hits array<struct<key: double, id: bigint>>")
    )
    # Largest score first, then smallest id: the key is the score turned round.
    best = F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, params.k)
    return (
        local.groupBy("query_id")
        .agg(best.alias("best"))
        .select("query_id", F.posexplode("best").alias("at", "hit"))
        .select(
            "query_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("hit.id").alias("vec_id"),
            (-F.col("hit.key")).alias("score"),
        )
    )
