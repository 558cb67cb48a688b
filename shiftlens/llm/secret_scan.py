"""Secrets in texts: fixed patterns, and unusual strings found by sliding-window entropy.

Fixed patterns (kinds ``assign``, ``access``, ``hex``) are leftmost, non-overlapping per kind.
Beside them, every candidate string (a run of token characters) is searched with a window of
fixed width: the Shannon entropy of the window's characters is kept up to date by adding the
entering and removing the leaving character, and compared with the threshold of the string's
character class.  Windows over the threshold are joined to one span (kind ``entropy``).
Candidates on the allow list (identifiers that are meant to be public, words, plain numbers,
paths) are suppressed, and so are spans that overlap a fixed pattern.

Null texts count as empty and have no spans.  Repeated rows are answered row by row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

KINDS = ("assign", "access", "hex", "entropy")

# The patterns of the contract.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")

# The keyword must hold one of these, so most texts are answered by six substring searches.
KEYWORD_PARTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")


@dataclass(frozen=True)
class EntropyRules:
    """Window width and bits per character that a window of each class must exceed."""

    width: int = 20
    hexadecimal: float = 3.0
    alphanumeric: float = 3.6
    base64: float = 3.8
    allow: tuple[str, ...] = ("example", "abcdefghij", "0123456789")


def candidate_class(value: str) -> str | None:
    """Character class of a candidate, or None if it cannot be a generated secret.

    Without a digit it is a word; without a letter a number.
    """
    if not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return "hexadecimal"
    return "alphanumeric" if value.isalnum() else "base64"


def allowed(value: str, rules: EntropyRules) -> bool:
    """On the allow list: public identifiers, listed fragments, slash-separated words, and dashes only."""
    low = value.lower()
    if UUID.match(value) or any(a in low for a in rules.allow):
        return True
    pieces = re.split(r"[/_=+-]+", value)
    longest = max((len(p) for p in pieces if any(c.isdigit() for c in p)), default=0)
    return longest < 12  # a path or slug of short parts


def entropy_windows(value: str, width: int, least: float) -> list[tuple[int, int]]:
    """Joined windows of ``value`` whose entropy is over ``least``, by incremental counts."""
    if len(value) < width:
        return []
    plogp = [0.0] + [k * math.log2(k) for k in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c) over the window's characters
    spans: list[tuple[int, int]] = []
    for i, char in enumerate(value):
        c = counts.get(char, 0)
        total += plogp[c + 1] - plogp[c]
        counts[char] = c + 1
        if i >= width:
            old = value[i - width]
            c = counts[old]
            total += plogp[c - 1] - plogp[c]
            counts[old] = c - 1
        if i >= width - 1 and math.log2(width) - total / width > least:
            start = i - width + 1
            if spans and spans[-1][1] >= start:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns, sorted by start, then kind."""
    out = []
    low = text.lower()
    if any(p in low for p in KEYWORD_PARTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # A run of hex digits is maximal, so "16 or more" can stand in the pattern.
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def entropy_spans(
    text: str, taken: list[tuple[int, int, int]], rules: EntropyRules
) -> list[tuple[int, int, int]]:
    """Spans over the threshold that overlap none of ``taken`` (sorted by start).

    Both come in order of their starts, so they are walked together: a taken span that ends before
    a found one starts can meet no later one either.  Taken spans of different kinds may overlap, so
    what counts of those passed is the furthest end.
    """
    out, k, furthest = [], 0, 0
    for m in CANDIDATE.finditer(text):
        value = m.group()
        kind = candidate_class(value)
        if kind is None or allowed(value, rules):
            continue
        for a, b in entropy_windows(value, rules.width, getattr(rules, kind)):
            start, end = m.start() + a, m.start() + b
            while k < len(taken) and taken[k][0] < end:
                furthest = max(furthest, taken[k][2])
                k += 1
            if furthest <= start:
                out.append((start, 3, end))
    return out


def all_spans(text: str, rules: EntropyRules) -> list[tuple[int, int, int]]:
    base = fixed_spans(text)
    return sorted(base + entropy_spans(text, base, rules))


SPAN = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("end", T.LongType()),
    ]
)


def scan_secrets(docs: DataFrame, text: str = "text", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """``docs`` with ``secret_spans``: array of (start, kind, end) in code points, end exclusive.

    Spans are ordered by start, then kind as listed in ``KINDS``.  Null and empty texts get an
    empty array.  All columns of ``docs`` stay; the scan needs no shuffle.
    """

    @F.pandas_udf(T.ArrayType(SPAN))
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(
                [[(s, KINDS[k], e) for s, k, e in all_spans(t, rules)] if t else [] for t in batch]
            )

    return docs.withColumn("secret_spans", spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[kind]``; overlapping spans become one.

    Clean texts, null ones included, come back unchanged, and so do all other columns.
    """

    @F.pandas_udf(T.StringType())
    def cleaned(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([redacted(t, rules) if t else t for t in batch])

    return docs.withColumn(text, cleaned(F.col(text)))


def redacted(text: str, rules: EntropyRules) -> str:
    out, at = [], 0
    for start, kind, end in all_spans(text, rules):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def span_digests(scanned: DataFrame) -> DataFrame:
    """Counts of the fixed kinds and the joined spans of ``scan_secrets``' rows."""
    spans = F.col("secret_spans")

    def joined(items):
        return F.array_join(
            F.transform(
                items,
                lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
            ),
            ",",
        )

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda s: s["kind"] != "entropy")
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


