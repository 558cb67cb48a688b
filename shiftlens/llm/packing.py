"""Packing of tokenised documents into sequences of fixed length.

Each partition packs its documents online with bounded space: a fixed number of windows is open;
a document's rest (after its full-length slices, which are sequences of their own) goes whole
into the open window it fits best; when it fits none, the fullest window is topped up with the
document's beginning and emitted, and what is left opens a new window.  The windows still open at
the end of the partitions are merged: a bounded number of partitions at a time, their tokens are
laid end to end and cut anew; the last cut of a merge ends in power-of-two lengths, which need no
padding.

Every token lies in exactly one piece, and every piece carries its token ids.  Null texts count
as empty; an empty document is its end token alone.  Rows are packed one by one, so repeated rows
and rows without doc_id are packed as often as they occur.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from shiftlens.llm.shared import stored

END = b"\x00\x00\x00\x00"  # token id 0 closes every document


@dataclass(frozen=True)
class PackParams:
    capacity: int = 1024
    open_windows: int = 64
    least_cut: int = 16  # gaps under this many tokens are not topped up
    words: int = 1_000_000  # whose ids a worker keeps during a task
    chunk: int = 4_000_000  # characters of text that are tokenised together
    merged_partitions: int = 4  # whose leftovers meet in one group, that many times open_windows windows


#: White space other than blank and line feed: in one byte, and in UTF-8 of two or three.
NARROW = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
WIDE = [c.encode() for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))]
PUNCTUATION = [k for k in range(33, 127) if not chr(k).isalnum()]
#: Of a byte: 1 for blank and line feed, 2 for NARROW, 3 for the first byte of any in WIDE, 4 for a letter of ASCII.
KIND = np.zeros(256, np.uint8)
KIND[[10, 32]], KIND[list(NARROW)], KIND[[w[0] for w in WIDE]] = 1, 2, 3
KIND[[k for k in range(128) if chr(k).isalpha()]] = 4
WIDE_CODES = np.array([int.from_bytes(w.ljust(3, b"\0"), "big") for w in WIDE])
BYTE_VALUES = np.random.default_rng(29).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
FACTOR = np.uint64(0x5851F42D4C957F2D)


def unit_hashes(data: np.ndarray, starts: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Two 64-bit hashes of every unit of ``data``, (2, units); a unit ends where the next starts."""
    ends = np.append(starts[1:], len(data))
    out = np.zeros((2, len(starts)), np.uint64)
    powers = np.full(int((ends - starts).max(initial=1)), FACTOR)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + block, side="right")))
        part, own = data[starts[a] : ends[b - 1]], starts[a:b] - starts[a]
        weight = powers[np.arange(len(part)) - np.repeat(own, ends[a:b] - starts[a:b])]
        for k in (0, 1):
            out[k, a:b] = np.add.reduceat(BYTE_VALUES[k][part] * weight, own)
        a = b
    return out


def odd_places(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where white space other than blank and line feed starts in UTF-8 text; ``kind`` is KIND of its bytes."""
    wide = np.flatnonzero(kind == 3)
    if len(wide):
        lead = data[wide].astype(np.int64)
        second, third = (data[np.minimum(wide + k, len(data) - 1)].astype(np.int64) for k in (1, 2))
        third[lead < 0xE0] = 0  # two bytes
        wide = wide[np.isin(lead << 16 | second << 8 | third, WIDE_CODES)]
    return np.concatenate([np.flatnonzero(kind == 2), wide])


def told_apart(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, where the first of each is, and which of them every key is; without a sort."""
    which, distinct = pd.factorize(keys)
    example = np.empty(len(distinct), np.int64)
    example[which[::-1]] = np.arange(len(keys))[::-1]  # the first is written last
    return distinct, example, which


class CachedTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Byte-level BPE never joins letters across a single blank or line feed between two other
    characters, so a text is put together from the ids of its units, each a blank or line feed and
    the word behind it (a line feed is put before the text, and its id taken off again).  Where the
    tokenizer ends a piece between a letter of ASCII and a punctuation mark, a unit ends there too, so
    a word is learnt once whatever mark follows it.  Many texts are one array of bytes; their distinct units, told apart by two 64-bit hashes, are looked up, and
    those that are not known are encoded together and cut at the blank or line feed of each.  Texts
    with any other white space, or with two in a row, go through the tokenizer whole.

    At most ``most`` units are kept; when more come, the memory starts anew.
    """

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.most = most
        self.known: dict[int, bytes] = {}  # ids by the unit's first hash
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.plain_feed = len(feed) == 1
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # How the vocabulary writes a blank at the start of a token.
        blank = self.tokenizer.id_to_token(self.tokenizer.encode(" ", add_special_tokens=False).ids[0])
        opens = np.zeros((2, max(vocabulary.values()) + 1), dtype=bool)
        opens[0, [i for token, i in vocabulary.items() if token.startswith(blank)]] = True
        opens[1, feed] = True
        self.opens = {32: opens[0], 10: opens[1]}
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.tokenizer.pre_tokenizer else lambda text: [(text, 0)]
        self.kind = KIND.copy()  # 5 for the marks that are never one piece with a letter before them
        self.kind[[k for k in PUNCTUATION if cut(f"a{chr(k)}")[0][0] == cut(f"a{chr(k)}a")[0][0] == "a"]] = 5

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def encoded(self, units: list[bytes], mark: int, each: int = 2000) -> list[bytes]:
        """Ids of units that all start with ``mark``, written one after the other."""
        out = []
        texts = [b"".join(units[k : k + each]).decode() for k in range(0, len(units), each)]
        for k, found in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, dtype="<u4")
            own = units[each * k : each * (k + 1)]
            starts = np.flatnonzero(self.opens[mark][ids])
            if len(starts) != len(own):  # not told apart: one by one
                out += self.whole([u.decode() for u in own])
                continue
            raw, bounds = ids.tobytes(), [*(starts * 4).tolist(), 4 * len(ids)]
            out += [raw[i:j] for i, j in zip(bounds, bounds[1:])]
        return out

    def learn(self, hashes: list[int], units: list[bytes]) -> dict[int, bytes]:
        """Ids of new units by their hash; they are known from now on."""
        new = {}
        for mark in self.opens:
            own = [k for k, u in enumerate(units) if u[0] == mark]
            new.update(zip([hashes[k] for k in own], self.encoded([units[k] for k in own], mark)))
        own = [k for k, u in enumerate(units) if u[0] not in self.opens]
        new.update(zip([hashes[k] for k in own], self.whole([units[k].decode() for k in own])))
        if len(self.known) + len(new) > self.most:
            self.known.clear()
        self.known.update(new)
        return new

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, its end token included."""
        raw = [b"\n" + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        kind = self.kind[data]
        begins = kind == 1
        begins[1:] |= (kind[1:] == 5) & (kind[:-1] == 4)
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.append(starts, len(data)))
        first = np.searchsorted(starts, bounds)  # a text's first unit; texts start with a line feed
        odd = np.zeros(len(texts), bool)
        single = np.concatenate([odd_places(data, kind), starts[(lengths == 1) & (kind[starts] == 1)]])
        odd[np.searchsorted(bounds, single, side="right") - 1] = True
        if not self.plain_feed:
            odd[:] = True
        out: list = [END] * len(texts)
        use = np.repeat(~odd, np.diff(first))
        starts, lengths = starts[use], lengths[use]
        if len(starts):
            ids, at = self.gathered(joined, data, starts, lengths)
            counts = np.where(odd, 0, np.diff(first))
            ends = np.cumsum(counts)
            for k in np.flatnonzero(counts):
                out[k] = ids[4 * (at[ends[k] - counts[k]] + 1) : 4 * at[ends[k]]] + END  # without the feed
        some = [k for k in np.flatnonzero(odd) if texts[k]]
        for k, ids in zip(some, self.whole([texts[k] for k in some])):
            out[k] = ids + END
        return out

    def gathered(self, joined: bytes, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Ids of all units one after the other, and where those of each start (and the last end)."""
        packed, ends = data, np.cumsum(lengths)
        if ends[-1] != len(data):  # units of other texts lie between
            packed = data[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]
        key, check = unit_hashes(packed, ends - lengths)
        distinct, example, which = told_apart(key)
        if (check != check[example][which]).any():
            raise ValueError("two words with one hash")  # once in 2 ** 64 pairs
        names = distinct.tolist()
        runs = list(map(self.known.get, names))
        missing = [k for k, found in enumerate(runs) if found is None] if None in runs else []
        if missing:
            places = zip(starts[example[missing]].tolist(), lengths[example[missing]].tolist())
            new = self.learn([names[k] for k in missing], [joined[i : i + n] for i, n in places])
            for k in missing:
                runs[k] = new[names[k]]
        sizes = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        flat, offsets = np.frombuffer(b"".join(runs), "<u4"), np.cumsum(sizes) - sizes
        counts = sizes[which]
        at = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat(offsets[which] - at[:-1], counts) + np.arange(at[-1])
        return flat[places].tobytes(), at

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]

    def forget(self) -> None:
        self.known.clear()


@lru_cache(maxsize=1)
def tokenizer_of(path: str, words: int) -> CachedTokenizer:
    """One per Python worker; the words are forgotten at the end of each task."""
    return CachedTokenizer(path, words)


def chunked(ids: list, texts: list, most: int = 4_000_000, rows: int = 4000) -> Iterator[tuple[list, list]]:
    """Runs of rows of about ``most`` characters, so that neither memory nor an output batch grows
    with the input's batches."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= most or k + 1 - start >= rows or k + 1 == len(texts):
            yield ids[start : k + 1], texts[start : k + 1]
            start, size = k + 1, 0


class Packer:
    """Bounded-space best-fit packing of one partition; gives (window, closed, pieces)."""

    def __init__(self, params: PackParams) -> None:
        self.params = params
        self.gaps: list[tuple[int, int]] = []  # (free tokens, window), sorted
        self.held: dict[int, list[tuple]] = {}
        self.next = 0

    def new_window(self) -> int:
        self.next += 1
        return self.next - 1

    def put(self, window: int, gap: int, piece: tuple, length: int):
        self.held.setdefault(window, []).append((*piece, self.params.capacity - gap))
        if gap > length:
            insort(self.gaps, (gap - length, window))
            return []
        return [(window, True, self.held.pop(window))]

    def add(self, doc_id, ids: bytes) -> list[tuple]:
        size, total, out = self.params.capacity, len(ids) // 4, []

        def piece(start, end):
            return (doc_id, start, end - start, ids[4 * start : 4 * end], total)

        start = 0
        while total - start >= size:
            out.append((self.new_window(), True, [(*piece(start, start + size), 0)]))
            start += size
        if start == total:
            return out
        at = bisect_left(self.gaps, (total - start, -1))
        if at < len(self.gaps):
            gap, window = self.gaps.pop(at)
            return out + self.put(window, gap, piece(start, total), total - start)
        if len(self.gaps) >= self.params.open_windows:
            gap, window = self.gaps.pop(0)
            if gap >= self.params.least_cut:
                out += self.put(window, gap, piece(start, start + gap), gap)
                start += gap
            else:
                out.append((window, True, self.held.pop(window)))
        return out + self.put(self.new_window(), size, piece(start, total), total - start)

    def leftovers(self) -> list[tuple]:
        return [(w, False, pieces) for w, pieces in sorted(self.held.items())]


PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long"
NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "offset"]


def piece_batch(windows: list[tuple], part: int) -> pa.RecordBatch:
    columns = list(zip(*[(*p, window, closed) for window, closed, pieces in windows for p in pieces]))
    doc_id, start, length, ids, doc_tokens, offset, window, closed = columns
    long = pa.int64()
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(doc_id, long),
            "start": pa.array(start, long),
            "length": pa.array(length, long),
            "ids": pa.array(ids, pa.binary()),
            "doc_tokens": pa.array(doc_tokens, long),
            "part": pa.array([part] * len(start), pa.int32()),
            "window": pa.array(window, long),
            "offset": pa.array(offset, long),
            "closed": pa.array(closed, pa.bool_()),
        }
    )


def lengths_of(total: int, capacity: int) -> list[int]:
    """Full sequences, then the rest as falling powers of two."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    return out + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def merge(rows: pd.DataFrame, group: int, params: PackParams) -> pd.DataFrame:
    """Leftover pieces of a bounded number of partitions, laid end to end and cut anew."""
    rows = rows.sort_values(["part", "window", "offset"], kind="stable")
    lengths = lengths_of(int(rows["length"].sum()), params.capacity)
    out, sequence, used = [], 0, 0
    for doc_id, start, length, ids, doc_tokens in rows[NAMES[:5]].itertuples(index=False):
        done = 0
        while done < length:
            take = min(length - done, lengths[sequence] - used)
            cut = ids[4 * done : 4 * (done + take)]
            out.append((doc_id, start + done, take, cut, doc_tokens, (1 << 62) | (group << 32) | sequence, used))
            done, used = done + take, used + take
            if used == lengths[sequence]:
                sequence, used = sequence + 1, 0
    merged = pd.DataFrame(out, columns=[*NAMES[:5], "sequence_id", "offset"])
    merged["doc_id"] = merged["doc_id"].astype("Int64")
    return merged


def pack(docs: DataFrame, vocabulary: str, params: PackParams = PackParams()) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all ``docs``.

    ``docs`` has doc_id and text; ``vocabulary`` is the path of a tokenizer file that every worker
    can read.  The packed pieces are written once to the shared folder, since both the closed and
    the leftover windows are read from them.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tokens, packer = tokenizer_of(vocabulary, params.words), Packer(params)
        for batch in batches:
            for doc_ids, texts in chunked(batch.column(0).to_pylist(), batch.column(1).to_pylist(), params.chunk):
                out = []
                for doc_id, ids in zip(doc_ids, tokens.many(texts)):
                    out += packer.add(doc_id, ids)
                if out:
                    yield piece_batch(out, part)
        tokens.forget()
        pa.default_memory_pool().release_unused()
        if packer.held:
            yield piece_batch(packer.leftovers(), part)

    pieces = stored(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            packed, f"{PIECE}, part int, window long, offset long, closed boolean"
        )
    )
    done = pieces.where("closed").select(
        *NAMES[:5],
        F.shiftleft(F.col("part").cast("long"), 32).bitwiseOR(F.col("window")).alias("sequence_id"),
        "offset",
    )

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return merge(rows, int(key[0]), params)

    # A group has at most merged_partitions * open_windows windows.
    rest = (
        pieces.where("not closed")
        .withColumn("group", F.expr(f"part div {params.merged_partitions}"))
        .groupBy("group")
        .applyInPandas(merged, f"{PIECE}, sequence_id long, offset long")
    )
    return done.unionByName(rest)
