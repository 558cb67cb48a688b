"""Benchmark decontamination by winnowing.

A window is ``Windows.words`` consecutive words of a benchmark item; an item with fewer words is one
window.  Of every text the hashes of all k-grams of words are formed, and of every ``w`` consecutive
hashes the smallest is kept, the rightmost of equal ones.  Any ``w + k - 1`` words that two texts
share then hold a hash kept in both: with k = 5 and w = 6 every shared span of ten words is met.
Items of fewer words have a scheme of their own for their length L, with k = min(5, L) and
w = L - k + 1, run only for lengths that occur.

The kept hashes of documents and items are joined.  A hit is extended: the document's windows around
it are spelled out and joined with the items' windows as text, so hash collisions decide nothing.
Documents with the same text are compared once, by the md5 of the text; so are items with the same
window.  No pairs of documents and items are formed before the windows are known, and documents with
the same set of windows share one list of items.

A batch's texts are one array of bytes for numpy: words, their polynomial hashes (by differences of
running sums) and k-gram hashes come from array operations.  Words are found in UTF-8, where every
byte of a character beyond ASCII is part of a word.  Nothing of a text is cut off.

Null and empty texts have no words, are hit by nothing and hit nothing.  Repeated document rows give
repeated rows; rows of one item_id are one item; a null item_id counts as an item with an empty id.
Empty tables on either side give no hits.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shiftlens.llm.shared import stored


@dataclass(frozen=True)
class Windows:
    words: int = 10
    gram: int = 5

    def scheme(self, length: int) -> tuple[int, int]:
        """(k, w) by which windows of ``length`` words are met."""
        k = min(self.gram, length)
        return k, length - k + 1


# ---------------------------------------------------------------- words of many texts at once

_BYTE = np.arange(256)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
IN_WORD = ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (LOWER >= 128)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit number over all of its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0x5851F42D4C957F2D)  # odd, so it has an inverse modulo 2 ** 64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


BLOCK = 1 << 18
POWERS, INVERSES = _powers(BASE, BLOCK), _powers(INVERSE, BLOCK)


class Texts:
    """The words of some texts: where they start and end in ``data``, and whose they are."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        # A byte that is in no word ends every text.
        self.data = LOWER[np.frombuffer(b"".join(r + b" " for r in raw), np.uint8)]
        sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        inside = IN_WORD[self.data].astype(np.int8)
        steps = np.diff(inside, prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        self.first_byte = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.searchsorted(self.start, self.first_byte)
        self.n_words = np.diff(bounds)
        self.first_word = bounds[:-1]
        self.owner = np.repeat(np.arange(len(raw)), self.n_words)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, block by block of bytes."""
        out, n = np.zeros(len(self.start), np.uint64), len(self.start)
        a = 0
        while a < n:
            low = self.start[a]
            b = max(a + 1, int(np.searchsorted(self.end, low + BLOCK, side="right")))
            data = self.data[low : self.end[b - 1]]
            fits = len(data) <= BLOCK  # else it is one word longer than a block
            powers = POWERS if fits else _powers(BASE, len(data))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(BYTE_VALUE[data] * powers[: len(data)], out=sums[1:])
            start = self.start[a:b] - low
            inverses = INVERSES[start] if fits else np.ones(1, np.uint64)
            out[a:b] = _mixed((sums[self.end[a:b] - low] - sums[start]) * inverses)
            a = b
        return out

    def grams(self, words: np.ndarray, k: int) -> np.ndarray:
        """A hash of every k words from each word on; those that cross texts are not to be used."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = words[:n].copy()
        for j in range(1, k):
            out = out * BASE + words[j : j + n]
        return _mixed(out)

    def text_of(self, i: int, start: int, length: int) -> str:
        """``length`` words of text ``i`` from word ``start`` on, one blank between."""
        a = self.first_word[i] + start
        spans = zip(self.start[a : a + length], self.end[a : a + length])
        return b" ".join(self.data[s:e].tobytes() for s, e in spans).decode("utf-8", "surrogatepass")


def winnowed(owner: np.ndarray, grams: np.ndarray, k: int, w: int) -> np.ndarray:
    """Places of the hashes that are smallest of ``w`` consecutive ones inside a text."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        here = grams[j : j + n]
        smaller = here <= low
        low[smaller] = here[smaller]
        at[smaller] = np.flatnonzero(smaller) + j
    whole = owner[:n] == owner[w + k - 2 : w + k - 2 + n]
    at = at[whole]
    return at[np.diff(at, prepend=-1) != 0] if len(at) else at


def _pieces(batches, most: int = 4_000_000):
    """Batches with their texts, cut so that a piece holds about ``most`` characters of text."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        size, start = 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= most or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                size, start = 0, i + 1


PRINTS = "n_words long, prints array<struct<length:int,hash:long,place:int>>"


def _fingerprints(lengths: list[int], windows: Windows):
    """Batches with a column text -> the same without it, with n_words and prints."""
    shape = [pa.field("length", pa.int32()), pa.field("hash", pa.int64()), pa.field("place", pa.int32())]

    def run(batches):
        for piece, texts in _pieces(batches):
            t = Texts(texts)
            words = t.hashes()
            grams = {k: t.grams(words, k) for k, _ in map(windows.scheme, lengths)}
            found = [np.zeros(0, np.int64)]
            tags, values = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
            for length in lengths:
                k, w = windows.scheme(length)
                at = winnowed(t.owner, grams[k], k, w)
                found.append(at)
                values.append(grams[k][at])
                tags.append(np.full(len(at), length, np.int32))
            at, value, tag = np.concatenate(found), np.concatenate(values), np.concatenate(tags)
            owner = t.owner[at]
            order = np.argsort(owner, kind="stable")
            at, value, tag, owner = at[order], value[order], tag[order], owner[order]
            offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            place = (at - t.first_word[owner]).astype(np.int32)
            rows = pa.StructArray.from_arrays(
                [pa.array(tag), pa.array(value.view(np.int64)), pa.array(place)], fields=shape
            )
            kept = {n: piece.column(n) for n in piece.schema.names if n != "text"}
            kept |= {"n_words": pa.array(t.n_words.astype(np.int64))}
            kept |= {"prints": pa.ListArray.from_arrays(pa.array(offsets), rows)}
            yield pa.RecordBatch.from_pydict(kept)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


WINDOW_ROWS = "key binary, start int, length int, window string"
WINDOW_SCHEMA = pa.schema([("key", pa.binary()), ("start", pa.int32()), ("length", pa.int32()), ("window", pa.string())])


def _windows_around(windows: Windows):
    """(key, text, hits) -> the windows that contain a hit, each once."""

    def run(batches):
        for piece, texts in _pieces(batches):
            t, out = Texts(texts), []
            for i, (key, hits) in enumerate(zip(piece.column("key").to_pylist(), piece.column("hits").to_pylist())):
                n, done = int(t.n_words[i]), set()
                for hit in hits:
                    length, place = hit["length"], hit["place"]
                    k, _ = windows.scheme(length)
                    for start in range(max(0, place + k - length), min(place, n - length) + 1):
                        if (start, length) not in done:
                            done.add((start, length))
                            out.append((key, start, length, t.text_of(i, start, length)))
                    if len(out) >= 20_000:
                        yield _batch(out, WINDOW_SCHEMA)
                        out = []
            yield _batch(out, WINDOW_SCHEMA)

    return run


ITEM_ROWS = "item_id string, length int, window string"
ITEM_SCHEMA = pa.schema([("item_id", pa.string()), ("length", pa.int32()), ("window", pa.string())])


def _item_windows(windows: Windows):
    def run(batches):
        for piece, texts in _pieces(batches):
            t, out = Texts(texts), []
            for i, item in enumerate(piece.column("item_id").to_pylist()):
                n = int(t.n_words[i])
                length = min(n, windows.words)
                for start in range(n - length + 1 if n else 0):
                    out.append((item, length, t.text_of(i, start, length)))
                    if len(out) >= 20_000:
                        yield _batch(out, ITEM_SCHEMA)
                        out = []
            yield _batch(out, ITEM_SCHEMA)

    return run


# ---------------------------------------------------------------- the operator


def text_key():
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def item_windows(benchmark: DataFrame, windows: Windows = Windows()) -> DataFrame:
    """(item_id as text, length, window): every different window of every item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return items.mapInArrow(_item_windows(windows), ITEM_ROWS).distinct()


def window_prints(own: DataFrame, lengths: list[int], windows: Windows) -> DataFrame:
    """(length, hash): what the scheme of a window's own length keeps of it."""
    spelled = own.select(F.col("window").alias("text"))
    prints = spelled.mapInArrow(_fingerprints(lengths, windows), PRINTS)
    prints = prints.select("n_words", F.explode("prints").alias("p")).where("p.length = n_words")
    return prints.select("p.length", "p.hash").distinct()


def matched_windows(documents: DataFrame, prints: DataFrame, own: DataFrame, lengths: list[int], windows: Windows) -> DataFrame:
    """(key, start, length, window): the item windows ``own`` that occur in documents, by text key."""
    known = stored(window_prints(own, lengths, windows))
    places = prints.select("key", F.explode("prints").alias("p")).select("key", "p.length", "p.hash", "p.place")
    hits = stored(
        places.join(known, ["length", "hash"], "left_semi")
        .groupBy("key")
        .agg(F.collect_set(F.struct("length", "place")).alias("hits"))
    )
    # One text of each key: copies are gone before the texts are shuffled.
    texts = documents.select(text_key().alias("key"), "text").join(hits.select("key"), "key", "left_semi")
    texts = texts.groupBy("key").agg(F.first("text").alias("text")).join(hits, "key")
    around = texts.select("key", "text", "hits").mapInArrow(_windows_around(windows), WINDOW_ROWS)
    return around.join(own, ["length", "window"], "left_semi").select("key", "start", "length", "window")


def hit_spans(found: DataFrame) -> DataFrame:
    """(key, n_hit, spans): the words inside windows, overlapping and touching windows merged."""
    order = Window.partitionBy("key").orderBy("start", "length")
    rows = found.select("key", "start", "length", (F.col("start") + F.col("length")).alias("end"))
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", (before.isNull() | (F.col("start") > before)).cast("int"))
    rows = rows.withColumn("span", F.sum("fresh").over(order))
    spans = rows.groupBy("key", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("key").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_hit"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )


def item_lists(found: DataFrame, items: DataFrame) -> DataFrame:
    """(key, items): ids of the items with a window in the text, looked up once per set of windows."""
    sets = found.groupBy("key").agg(F.sort_array(F.collect_set("window")).alias("windows"))
    sets = sets.withColumn("set", F.md5(F.array_join("windows", "\n")))
    rows = sets.groupBy("set").agg(F.first("windows").alias("windows")).select("set", F.explode("windows").alias("window"))
    lists = rows.join(items, "window").groupBy("set").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return sets.select("key", "set").join(lists, "set").select("key", "items")


def decontaminate(documents: DataFrame, benchmark: DataFrame, windows: Windows = Windows()) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit (words inside item windows), spans (array of start and
    end, in words, merged), items (ids as text, in order), contaminated."""
    items = stored(item_windows(benchmark, windows))
    own = items.select("length", "window").distinct()
    lengths = sorted(r.length for r in items.select("length").distinct().collect())  # ten values at most
    keyed = documents.select("doc_id", text_key().alias("key"), "text")
    base = stored(keyed.mapInArrow(_fingerprints(lengths, windows), f"doc_id long, key binary, {PRINTS}"))
    found = stored(matched_windows(documents, base, own, lengths, windows))
    result = stored(hit_spans(found).join(item_lists(found, items), "key"))
    return (
        base.select("doc_id", "key", "n_words")
        .join(result, "key", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )
