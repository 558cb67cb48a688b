"""Document quality from random-indexing word vectors and a small network.

Every token (a word in its own spelling, or a run of marks) is hashed to one of ``buckets``
numbers and has a sparse random index vector.  One pass over all texts adds to each token's
context vector the index vectors of its left and right neighbours; partitions add up locally,
so only one bounded table per partition is shuffled, and the finished table (``buckets`` x
``dim`` numbers, 4 MB by default) has the same size for any corpus.

A document is pooled to mean and spread of its tokens' unit vectors, the length of the mean and
the mean likeness of neighbouring tokens.  A two-layer network, written in numpy, turns that
into a logit; its temperature is fitted on training rows that the network has not seen.

Only the network is fitted on a sample (``max_per_class`` labelled training rows of each class,
weighted back to the classes' true counts).  Null and empty texts pool to zeros and get the
network's score for that.  Without labels of both classes every score is the share of label 1
(0.5 without labels).  Repeated rows are answered row by row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from shiftlens.llm.toxicity import sigmoid

TOKEN = re.compile(r"\w+|[^\w\s]+")


@dataclass(frozen=True)
class QualityParams:
    buckets: int = 1 << 15
    dim: int = 32
    nonzero: int = 4
    hidden: int = 32
    max_per_class: int = 2000
    epochs: int = 250
    rate: float = 0.01
    decay: float = 1e-3
    seed: int = 5


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray  # (buckets, dim) unit rows
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


class TokenHasher:
    """Texts to bucket numbers; remembers the tokens of at most ``most`` strings between blanks."""

    def __init__(self, buckets: int, most: int = 400_000) -> None:
        self.buckets, self.most = buckets, most
        self.seen: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> np.ndarray:
        parts = text.split()
        seen, n = self.seen, self.buckets
        new = set(parts).difference(seen)
        if len(seen) + len(new) > self.most:
            seen.clear()
            new = set(parts)
        for part in new:
            seen[part] = tuple(zlib.crc32(t.encode()) % n for t in TOKEN.findall(part))
        return np.fromiter(chain.from_iterable(map(seen.__getitem__, parts)), dtype=np.int32)


def index_vectors(params: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each bucket's sparse random vector."""
    rng = np.random.default_rng(params.seed)
    shape = (params.buckets, params.nonzero)
    return rng.integers(0, params.dim, shape), rng.choice([-1.0, 1.0], shape)


class ContextSums:
    """Context vectors of the tokens seen so far."""

    def __init__(self, params: QualityParams, flush: int = 500_000) -> None:
        self.params, self.flush = params, flush
        self.place, self.sign = index_vectors(params)
        self.total = np.zeros(params.buckets * params.dim)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, ids: np.ndarray) -> None:
        for at in range(0, len(ids) - 1, self.flush):
            part = ids[at : at + self.flush + 1]
            self.pairs += [(part[:-1], part[1:]), (part[1:], part[:-1])]
            self.waiting += len(part)
            if self.waiting >= self.flush:
                self.sum_up()

    def sum_up(self) -> None:
        if self.pairs:
            word = np.concatenate([a for a, _ in self.pairs])
            near = np.concatenate([b for _, b in self.pairs])
            cells = word[:, None].astype(np.int64) * self.params.dim + self.place[near]
            self.total += np.bincount(
                cells.ravel(), weights=self.sign[near].ravel(), minlength=len(self.total)
            )
            self.pairs, self.waiting = [], 0

    def table(self) -> np.ndarray:
        self.sum_up()
        return self.total.reshape(self.params.buckets, self.params.dim)


def context_table(docs: DataFrame, params: QualityParams) -> np.ndarray:
    """(buckets, dim) context sums over the whole texts of all documents."""
    names = [f"s{k}" for k in range(params.dim)]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, own = TokenHasher(params.buckets), ContextSums(params)
        for batch in batches:
            for text in batch["text"]:
                if text:
                    own.add(hasher(text))
        table = own.table().astype(np.int64)
        used = np.flatnonzero(table.any(axis=1))
        out = pd.DataFrame(table[used], columns=names)
        out.insert(0, "bucket", used)
        yield out

    schema = "bucket long, " + ", ".join(f"{n} long" for n in names)
    rows = (
        docs.select("text")
        .mapInPandas(sums, schema)
        .groupBy("bucket")
        .agg(*[F.sum(n).alias(n) for n in names])
        .toPandas()  # at most one row per bucket
    )
    out = np.zeros((params.buckets, params.dim))
    out[rows["bucket"].to_numpy(dtype=int)] = rows[names].to_numpy(dtype=float)
    return out


def word_vectors(table: np.ndarray, params: QualityParams) -> np.ndarray:
    """Unit vectors: damped context plus the token's own index vector."""
    place, sign = index_vectors(params)
    out = np.sign(table) * np.log1p(np.abs(table))
    own = np.zeros_like(out)
    np.add.at(own, (np.arange(len(own))[:, None], place), sign)
    out = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9) + own / params.nonzero**0.5
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, ids: np.ndarray, block: int = 200_000) -> np.ndarray:
    """Mean, spread, length of the mean, and likeness of neighbours, in blocks of tokens."""
    dim = vectors.shape[1]
    if not len(ids):
        return np.zeros(2 * dim + 3)
    total, squares, near = np.zeros(dim), np.zeros(dim), 0.0
    for at in range(0, len(ids), block):
        part = vectors[ids[at : at + block + 1]]
        near += float(np.einsum("ij,ij->", part[1:], part[:-1]))
        part = part[:block]
        total += part.sum(axis=0)
        squares += np.einsum("ij,ij->j", part, part)
    mean = total / len(ids)
    spread = np.sqrt(np.maximum(squares / len(ids) - mean * mean, 0))
    return np.r_[mean, spread, np.linalg.norm(mean), near / len(ids), np.log1p(len(ids))]


def forward(x, w1, b1, w2, b2):
    hidden = np.maximum(x @ w1 + b1, 0)
    return hidden, hidden @ w2 + b2


def fit_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, params: QualityParams):
    """Two layers by Adam on the weighted log loss."""
    rng = np.random.default_rng(params.seed)
    p = [
        rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], params.hidden)),
        np.zeros(params.hidden),
        rng.normal(0, (1 / params.hidden) ** 0.5, params.hidden),
        np.zeros(1),
    ]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(params.epochs):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 512)):
            hidden, z = forward(x[part], p[0], p[1], p[2], p[3][0])
            g = weight[part] * (sigmoid(z) - y[part]) / weight[part].sum()
            back = np.outer(g, p[2]) * (hidden > 0)
            grads = [x[part].T @ back, back.sum(axis=0), hidden.T @ g, np.array([g.sum()])]
            step += 1
            for k, grad in enumerate(grads):
                grad = grad + params.decay * p[k] * (k in (0, 2))
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                p[k] = p[k] - params.rate * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                )
    return p[0], p[1], p[2], float(p[3][0])


def fit_temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature of least weighted log loss on rows the network has not seen."""

    def loss(t):
        q = np.clip(sigmoid(z / t), 1e-6, 1 - 1e-6)
        return -(weight * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum()

    return float(min(np.geomspace(0.25, 8, 61), key=loss))


def fit_head(x: np.ndarray, y: np.ndarray, weight: np.ndarray, vectors: np.ndarray, params: QualityParams):
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / scale
    unseen = np.arange(len(x)) % 5 == 4
    net = fit_network(x[~unseen], y[~unseen], weight[~unseen], params)
    temperature = 1.0
    if len(set(y[unseen].tolist())) == 2:
        temperature = fit_temperature(forward(x[unseen], *net)[1], y[unseen], weight[unseen])
    return QualityModel(vectors, mean, scale, *net, temperature)


def constant_model(share: float, vectors: np.ndarray, width: int) -> QualityModel:
    share = min(max(share, 1e-6), 1 - 1e-6)
    zeros = np.zeros((width, 1))
    logit = float(np.log(share / (1 - share)))
    return QualityModel(
        vectors, np.zeros(width), np.ones(width), zeros, np.zeros(1), np.zeros(1), logit, 1.0
    )


def train(docs: DataFrame, labels: DataFrame, held_out, params: QualityParams = QualityParams()):
    """Word vectors over all of ``docs``; network over labelled rows where ``held_out`` is false."""
    vectors = word_vectors(context_table(docs, params), params)
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"))
    )
    counts = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    picked = [
        usable.where(F.col("label") == k)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(params.max_per_class)
        for k in (0, 1)
    ]
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = TokenHasher(params.buckets)
        for batch in batches:
            rows = [pooled(sent.value, hasher(t or "")) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": rows})

    # Bounded by max_per_class, so the sample may be broadcast and its features collected.
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
        .mapInPandas(features, "doc_id long, label int, x array<double>")
        .collect()
    )
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.x))
    y = np.array([r.label for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return constant_model(float(y.mean()) if len(y) else 0.5, vectors, 2 * params.dim + 3)
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    return fit_head(np.array([r.x for r in rows]), y, weight / weight.mean(), vectors, params)


def score_ids(model: QualityModel, ids: np.ndarray) -> float:
    x = (pooled(model.vectors, ids) - model.mean) / model.scale
    z = forward(x, model.w1, model.b1, model.w2, model.b2)[1]
    return float(sigmoid(z / model.temperature))


def score(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """``docs`` with ``name``, the calibrated probability of label 1 of its whole text; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = sent.value
        hasher = TokenHasher(len(fitted.vectors))
        for batch in texts:
            yield pd.Series([score_ids(fitted, hasher(t or "")) for t in batch], dtype=float)

    return docs.withColumn(name, scored(F.col("text")))
