"""Toxicity scores from a factorization machine over hashed terms.

A text is cut into windows of ``window`` terms that overlap by half, so that terms up to half a
window apart always meet in one.  The distinct terms of a window, and their stems,
are hashed into ``buckets`` features x (counts), and the window's logit is

    b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i)

so that pairs of terms (an insult next to a group) carry weight of their own.  A document
scores as its worst window, which makes one toxic sentence count the same in a short and in a
very long text.  Training follows the same rule: for each labelled document the window that
scores highest gets the gradient.

The model is fitted on a bounded, documented sample of the labelled training rows
(``max_per_class`` documents of each label, all windows of each); scoring reads every window of
every text.

Null and empty texts have no window and score as the empty window, sigmoid(b).  Without
labels of both classes no model can be fitted: every score is then the share of label 1 (0
without any labels).  Repeated rows are answered row by row; a doc_id labelled more than
once counts with its largest label.
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

TERM = re.compile(r"[^\W_]+")
STEMS = (3, 5, 7)  # lengths of the stems hashed beside the whole term


@dataclass(frozen=True)
class FmParams:
    buckets: int = 1 << 18
    rank: int = 4
    window: int = 48
    max_per_class: int = 2000
    epochs: int = 10
    rate: float = 0.15
    l2: float = 2e-5
    seed: int = 11


@dataclass(frozen=True)
class FmModel:
    bias: float
    linear: np.ndarray  # (buckets + 1,), the last one is the padding
    factors: np.ndarray  # (buckets + 1, rank)
    window: int

    @property
    def buckets(self) -> int:
        return len(self.linear) - 1


def features_of(term: str, buckets: int) -> list[int]:
    """Hashed features of a term: the term and its stems, so that endings do not hide it."""
    stems = [f"{term[:n]}*" for n in STEMS if len(term) > n]
    return [zlib.crc32(f.encode()) % buckets for f in (term, *stems)]


def stride_of(width: int) -> int:
    return width - width // 2


def last_terms(parts: list[str], n: int) -> list[str]:
    """The last ``n`` terms of strings between blanks."""
    tail: list[str] = []
    for part in reversed(parts):
        if len(tail) >= n:
            break
        tail[:0] = TERM.findall(part)
    return tail[len(tail) - n :]


def term_windows(terms: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` term numbers, 0 where there is none; a term counts once per window."""
    stride = stride_of(width)
    n = max(1, -(-(len(terms) - width) // stride) + 1)
    out = np.zeros((n - 1) * stride + width, dtype=np.int32)
    out[: len(terms)] = terms
    out = np.sort(np.lib.stride_tricks.sliding_window_view(out, width)[::stride], axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = 0
    return out


def training_windows(text: str, params: FmParams) -> np.ndarray:
    """(windows, width * features per term) feature numbers, padded with ``buckets``."""
    pad, per_term = params.buckets, 1 + len(STEMS)
    words = TERM.findall(text.lower())
    number = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
    features = np.full((len(number) + 1, per_term), pad, dtype=np.int32)
    for w, i in number.items():
        ids = features_of(w, pad)
        features[i, : len(ids)] = ids
    rows = term_windows(np.array([number[w] for w in words], dtype=np.int32), params.window)
    return features[rows].reshape(len(rows), -1)


def logits(bias: float, w: np.ndarray, v: np.ndarray, x: np.ndarray) -> np.ndarray:
    vx = v[x]
    s = vx.sum(axis=1)
    return bias + w[x].sum(axis=1) + 0.5 * (s * s - (vx * vx).sum(axis=1)).sum(axis=1)


class TextScorer:
    """Scores texts of any length.

    The sums a term brings to its window (linear weight, factors, squared factors) are kept per
    term, in a table that starts anew when texts have brought ``most`` different strings.
    """

    def __init__(self, model: FmModel, most: int = 300_000) -> None:
        self.model, self.most = model, most
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.sums = np.zeros((4096, self.model.factors.shape[1] + 2), dtype=np.float32)

    def add(self, terms: list[str]) -> None:
        m, at = self.model, len(self.number) + 1
        while at + len(terms) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        features = np.full((len(terms), 1 + len(STEMS)), m.buckets, dtype=np.int32)
        for i, term in enumerate(terms):
            ids = features_of(term, m.buckets)
            features[i, : len(ids)] = ids
            self.number[term] = at + i
        v = m.factors[features]
        new = self.sums[at : at + len(terms)]
        new[:, 0] = m.linear[features].sum(axis=1)
        new[:, 1] = (v * v).sum(axis=(1, 2))
        new[:, 2:] = v.sum(axis=1)

    def numbers(self, parts: list[str]) -> np.ndarray:
        """Term numbers of strings between blanks."""
        seen = self.parts
        new = set(parts).difference(seen)
        if len(seen) + len(new) > self.most:
            self.reset()
            seen, new = self.parts, set(parts)
        found = {part: TERM.findall(part) for part in new}
        terms = dict.fromkeys(chain.from_iterable(found.values()))
        if unknown := [t for t in terms if t not in self.number]:
            self.add(unknown)
        for part, own in found.items():
            seen[part] = tuple(self.number[t] for t in own)
        return np.fromiter(chain.from_iterable(map(seen.__getitem__, parts)), dtype=np.int32)

    def __call__(self, text: str | None, block: int = 100_000) -> float:
        """Probability of the text's worst window; long texts go through in blocks of words."""
        width, worst = self.model.window, -np.inf
        stride, carried = stride_of(width), []
        parts = (text or "").lower().split()
        for at in range(0, max(1, len(parts)), block):
            here = carried + parts[at : at + block]
            terms = self.numbers(here)
            if at + block < len(parts):
                # Whole windows only; what the next one starts with goes on to the next block.
                n = max(0, (len(terms) - width) // stride + 1)
                carried = last_terms(here, len(terms) - n * stride)
                if n == 0:
                    continue
                terms = terms[: (n - 1) * stride + width]
            elif worst > -np.inf and len(terms) <= width - stride:
                continue  # the window before held them all
            rows = term_windows(terms, width)
            sums = self.sums[rows].sum(axis=1)
            s = sums[:, 2:]
            z = self.model.bias + sums[:, 0] + 0.5 * ((s * s).sum(axis=1) - sums[:, 1])
            worst = max(worst, float(z.max()))
        return float(sigmoid(worst))


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: list[np.ndarray], labels: np.ndarray, params: FmParams) -> FmModel:
    """Fit on one (windows, width) array per document, by AdaGrad on the worst windows."""
    rng = np.random.default_rng(params.seed)
    pad = params.buckets
    w = np.zeros(pad + 1, dtype=np.float32)
    v = rng.normal(0, 0.01, (pad + 1, params.rank)).astype(np.float32)
    v[pad] = 0
    gw = np.full(pad + 1, 1e-2, dtype=np.float32)
    gv = np.full((pad + 1, params.rank), 1e-2, dtype=np.float32)
    bias, gb = -1.0, 1e-2
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    every = np.concatenate(docs)
    first = np.r_[0, np.cumsum([len(d) for d in docs])[:-1]]
    for epoch in range(params.epochs):
        if epoch < 2:
            # Before the model knows anything, a window of a positive document is positive.
            rows = rng.permutation(len(every))
        else:
            z = np.concatenate([logits(bias, w, v, x) for x in np.array_split(every, 1 + len(every) // 2048)])
            order = np.lexsort((-z, owner))
            rows = rng.permutation(order[first])
        for part in np.array_split(rows, max(1, len(rows) // 64)):
            x, y = every[part], labels[owner[part]]
            vx = v[x]
            s = vx.sum(axis=1)
            z = bias + w[x].sum(axis=1) + 0.5 * (s * s - (vx * vx).sum(axis=1)).sum(axis=1)
            g = ((sigmoid(z) - y) / len(part)).astype(np.float32)
            flat = x.ravel()
            used, where = np.unique(flat, return_inverse=True)
            dw = np.bincount(where, weights=np.repeat(g, x.shape[1]), minlength=len(used))
            dw = dw.astype(np.float32) + params.l2 * w[used]
            dvx = (g[:, None, None] * (s[:, None, :] - vx)).reshape(-1, params.rank)
            dv = np.stack(
                [np.bincount(where, weights=dvx[:, f], minlength=len(used)) for f in range(params.rank)], 1
            ).astype(np.float32) + params.l2 * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= params.rate * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * params.rate * dv / np.sqrt(gv[used])
            w[pad], v[pad] = 0, 0
            db = float(g.sum())
            gb += db * db
            bias -= params.rate * db / gb**0.5
    return FmModel(float(bias), w, v, params.window)


def training_rows(labels: DataFrame, label: str, held_out, most: int) -> DataFrame:
    """(doc_id, label): at most ``most`` rows of each class, in the order of their id's hash."""
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out)
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
    )
    picked = [
        usable.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)
    ]
    return picked[0].unionByName(picked[1])


def training_sample(docs: DataFrame, labels: DataFrame, held_out, params: FmParams):
    """(list of window arrays, labels) of the bounded sample, hashed on the executors."""
    columns = params.window * (1 + len(STEMS))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [training_windows(t or "", params).astype("<i4").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "windows": out})

    # The sample is bounded by its parameter, so its ids may be broadcast.
    chosen = F.broadcast(training_rows(labels, "toxic", held_out, params.max_per_class))
    rows = (
        docs.select("doc_id", "text")
        .join(chosen, "doc_id")
        .mapInPandas(hashed, "doc_id long, label int, windows binary")
        .collect()
    )
    rows = sorted(rows, key=lambda r: (r.doc_id, bytes(r.windows)))
    return (
        [np.frombuffer(r.windows, dtype="<i4").reshape(-1, columns) for r in rows],
        np.array([r.label for r in rows], dtype=np.float32),
    )


def train(docs: DataFrame, labels: DataFrame, held_out, params: FmParams = FmParams()) -> FmModel:
    """Fit on labelled rows for which ``held_out`` (a column over doc_id) is false."""
    samples, y = training_sample(docs, labels, held_out, params)
    if len(set(y.tolist())) == 2:
        return fit(samples, y, params)
    share = float(y.mean()) if len(y) else 0.0
    bias = 30.0 if share == 1.0 else -30.0
    zeros = np.zeros(params.buckets + 1, dtype=np.float32)
    return FmModel(bias, zeros, np.zeros((params.buckets + 1, params.rank), np.float32), params.window)


def score(docs: DataFrame, model: FmModel, name: str = "score") -> DataFrame:
    """``docs`` with ``name``, the probability of label 1 of its whole text; no shuffle.

    The model (5 MB with the default sizes, whatever the corpus) goes out as a broadcast
    variable and is read once per Python worker.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = TextScorer(sent.value)
        for batch in texts:
            yield pd.Series([scorer(t) for t in batch], dtype=float)

    return docs.withColumn(name, scored(F.col("text")))
