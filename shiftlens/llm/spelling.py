"""Spelling variants: words one edit apart, found by dense prefix-suffix tiles.

Two words are near if one inserted, deleted or replaced code point makes them equal.  Then the length
of their common prefix and the rest's common suffix reach the longer length minus one, which is what
the tiles test, on padded matrices of code points, every row of a block against every other at once.

Blocks.  With m the shorter length, the places 0..m are cut into segments, and the edit lies in one of
them; all before and behind it is common.  So a word is listed under (m, segment, hash of what lies
outside the segment) for m = its length and m = its length - 1, and near words meet in the block of
their edit.  Only the segment itself has to be compared; an edit that could stand in several places
counts in the first segment that is behind the common prefix, so a pair is found in one block only.
A hash decides nothing: found pairs are compared as whole words.  Segments have three code points in
words of up to 24; longer words have eight segments.

A block of more than ``TILE`` words is dealt out as pairs of tiles, so no task holds more than two
tiles at once, whatever a block's size.  The comparisons inside a block are quadratic in its size.

Words are counted per batch of documents before the shuffle.  Null and empty texts have no words;
repeated rows count again; a null doc_id counts as an empty one.  Empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shiftlens.llm.shared import stored

LEAST_LENGTH = 7
LEAST_COUNT = 2
STRONGER = 10
TILE = 1024
CELLS = 2_000_000

#: Runs that are too short to give a word are not looked at.
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
LOWER = {c: c + 32 for c in range(65, 91)}


def _count_words(batches):
    """(doc_id, text) -> (word, n), added up over a part of the task's documents.

    Where 31 divides the crc32 of ``doc_id:run``, the run loses the code point that the crc32 names.
    """
    found: Counter[str] = Counter()

    def batch():
        words = list(found)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([found[w] for w in words], pa.int64())], names=["word", "n"]
        )

    for part in batches:
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            if not text:
                continue
            shown = "" if doc_id is None else str(doc_id)
            start = zlib.crc32(f"{shown}:".encode())
            runs: Counter[str] = Counter()
            for run, n in Counter(RUN.findall(text)).items():
                runs[run.lower() if run.isascii() else run.translate(LOWER)] += n
            for run, n in runs.items():
                h = zlib.crc32(run.encode(), start)
                if h % 31 == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1 :]
                    if len(run) < LEAST_LENGTH:
                        continue
                found[run] += n
            if len(found) > 200_000:
                yield batch()
                found.clear()
    yield batch()


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) of words with enough code points and occurrences."""
    parts = documents.select(F.col("doc_id").cast("string"), "text").mapInArrow(_count_words, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---------------------------------------------------------------- blocks


def segment_count(m: int) -> int:
    return min(max(-(-m // 3), 2), 8)


def segment_bounds(m: int) -> list[int]:
    s = segment_count(m)
    return [m * j // s for j in range(s + 1)]


def block_rows(words: DataFrame) -> DataFrame:
    """(m, segment, block, word, n): a word under every block it may meet a near word in."""
    rows = words.select("word", "n", F.explode(F.expr("array(length(word) - 1, length(word))")).alias("m"))
    rows = rows.where(f"m >= {LEAST_LENGTH}").selectExpr("*", "least(greatest((m + 2) div 3, 2), 8) as segments")
    rows = rows.select("*", F.explode(F.expr("sequence(0, segments - 1)")).alias("segment"))
    before = "substring(word, 1, cast(m * segment div segments as int))"
    behind = "right(word, cast(m - m * (segment + 1) div segments as int))"
    return rows.selectExpr("m", "segment", f"xxhash64(m, segment, {before}, {behind}) as block", "word", "n")


def tiled(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """Blocks of more than one word, with columns ``tile`` and ``side``.

    A crowded block of N words is dealt into T = ceil(N / tile) parts by a hash of the word, and part
    a meets part b in the tile (a, b); ``side`` says which part a row is of.  Others are one tile.
    """
    key = ["m", "segment", "block"]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = rows.join(sizes, key).withColumn("parts", F.ceil(F.col("size") / F.lit(tile)).cast("long"))
    part = F.pmod(F.xxhash64("word", F.lit(7)), F.col("parts"))
    sized = sized.withColumn("part", part)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    sized = sized.withColumn("other", other)
    return sized.select(
        *key,
        (F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).alias("tile"),
        (F.col("part") > F.col("other")).cast("int").alias("side"),
        (F.col("part") == F.col("other")).alias("same"),
        "word",
        "n",
    )


# ---------------------------------------------------------------- tiles


def code_points(words: list[str], width: int) -> np.ndarray:
    """One row of code points per word, zeros behind it."""
    padded = np.array(words, dtype=f"U{max(width, 1)}")
    return padded.view(np.uint32).reshape(len(words), -1)


def one_edit(left: np.ndarray, right: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(is one edit, common prefix) of every row of ``left`` with every row of ``right``.

    ``left`` is (.., a, w), ``right`` (.., b, w + shift); shift 1 means that the right words are one
    code point longer.
    """
    w = left.shape[-1]
    shape = np.broadcast_shapes(left.shape[:-1] + (1,), right.shape[:-2] + (1, right.shape[-2]))
    prefix, suffix = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
    alive, back = np.ones(shape, bool), np.ones(shape, bool)
    for c in range(w):
        alive &= left[..., :, None, c] == right[..., None, :, c]
        prefix += alive
        back &= left[..., :, None, w - 1 - c] == right[..., None, :, w + shift - 1 - c]
        suffix += back
    enough = prefix + suffix >= w + shift - 1
    if not shift:
        enough &= prefix < w  # equal words are no pair
    return enough, prefix


class Tile:
    """Rows of one tile of a block."""

    def __init__(self, m: int, segment: int, rows: list[tuple]):
        self.m, self.segment, self.rows = m, segment, rows


def near_pairs(tiles: list[Tile]):
    """(word, n, near word, its n) of every near pair, found once; tiles share one (m, segment)."""
    m, segment = tiles[0].m, tiles[0].segment
    bounds = segment_bounds(m)
    low, high = bounds[segment], bounds[segment + 1]
    last = segment == len(bounds) - 2
    width = high - low
    groups: dict[tuple[int, int, int], list[tuple[list, list, int]]] = {}

    def padded(n: int) -> int:
        return 1 << (n - 1).bit_length()

    for tile in tiles:
        short = [[r for r in tile.rows if len(r[2]) == m and r[0] == side] for side in (0, 1)]
        long = [[r for r in tile.rows if len(r[2]) == m + 1 and r[0] == side] for side in (0, 1)]
        if tile.rows[0][1]:  # a part with itself
            meetings = [(short[0], short[0], 0), (short[0], long[0], 1)]
        else:
            meetings = [(short[0], short[1], 0), (short[0], long[1], 1), (short[1], long[0], 1)]
        for a, b, shift in meetings:
            if a and b and not (a is b and len(a) == 1):
                groups.setdefault((padded(len(a)), padded(len(b)), shift), []).append((a, b, shift))
    for (pa_, pb, shift), meetings in groups.items():
        at_once = max(1, CELLS // (pa_ * pb))
        for start in range(0, len(meetings), at_once):
            some = meetings[start : start + at_once]
            left = _stacked([a for a, _, _ in some], pa_, low, width)
            right = _stacked([b for _, b, _ in some], pb, low, width + shift)
            hit, prefix = one_edit(left, right, shift)
            if shift and not last:
                hit &= prefix < width  # else the edit counts in the segment behind
            for g, i, j in zip(*np.nonzero(hit)):
                a, b, _ = some[g]
                if i >= len(a) or j >= len(b) or (a is b and i >= j):
                    continue
                x, y = a[i], b[j]
                if x[2][:low] == y[2][:low] and x[2][high:] == y[2][high + shift :] and x[2] != y[2]:
                    yield x[2], x[3], y[2], y[3]


def _stacked(blocks: list[list[tuple]], rows: int, low: int, width: int) -> np.ndarray:
    """(block, row, code point) of the segments, padded with empty rows."""
    words = []
    for block in blocks:
        words += [r[2][low : low + width] for r in block]
        words += [""] * (rows - len(block))
    return code_points(words, width).reshape(len(blocks), rows, -1)


def _compare(batches):
    """Rows sorted by (m, segment, block, tile) -> both directions of every near pair."""

    def tiles():
        key, rows = None, []
        for batch in batches:
            for m, segment, block, tile, side, same, word, n in zip(*[c.to_pylist() for c in batch.columns]):
                if (m, segment, block, tile) != key:
                    if len(rows) > 1:
                        yield Tile(key[0], key[1], rows)
                    key, rows = (m, segment, block, tile), []
                rows.append((side, same, word, n))
        if len(rows) > 1:
            yield Tile(key[0], key[1], rows)

    def batch(pairs):
        columns = zip(*pairs) if pairs else ([], [], [])
        types = [pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], names=["word", "near", "near_n"]
        )

    held, size, out = [], 0, []
    for tile in tiles():
        other = held and (held[0].m, held[0].segment) != (tile.m, tile.segment)
        if other or size * max(1, tile.m // 8) > 200_000:
            for x, nx, y, ny in near_pairs(held):
                out += [(x, y, ny), (y, x, nx)]
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
            held, size = [], 0
        held.append(tile)
        size += len(tile.rows)
    if held:
        for x, nx, y, ny in near_pairs(held):
            out += [(x, y, ny), (y, x, nx)]
    yield batch(out)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, near, near_n): both directions of every pair of near words, once each."""
    key = ["m", "segment", "block", "tile"]
    rows = tiled(block_rows(words), tile).repartition(*key).sortWithinPartitions(*key)
    return rows.select(*key, "side", "same", "word", "n").mapInArrow(_compare, "word string, near string, near_n long")


# ---------------------------------------------------------------- the operator


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form.  A form has ten times its word's count, so a chain has at
    most 19 words, and paths that double each round are at their ends after five."""
    paths = stored(forms.select("word", F.col("form").alias("root")))
    for _ in range(5):
        further = paths.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        paths = stored(
            paths.join(further, F.col("root") == F.col("_at"), "left").select(
                "word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")
            )
        )
        moved = not paths.where("moved").isEmpty()
        paths = paths.select("word", "root")
        if not moved:
            break
    return paths


def spelling_variants(documents: DataFrame) -> DataFrame:
    """Per word: word, form (its near word of largest count, at least ten times its own), root (the
    end of the chain of forms), n, n_near, form_n."""
    words = stored(word_counts(documents))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    strong = F.col("best.less") <= -STRONGER * F.col("n")
    rows = stored(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("best.near")).alias("form"),
            F.when(strong, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = with_roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
