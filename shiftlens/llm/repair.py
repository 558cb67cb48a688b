"""Conversation structure repair: generalised LR parsing with weighted edits.

The grammar of roles is ``(s?(ua)+)?``: an optional system turn, then pairs of user and assistant.
Its parser has four stack tops: nothing yet, ``s``, an open ``u``, and ``P``, a list of whole pairs
(shifting ``a`` on ``u`` reduces both to a pair).  All readings of a conversation are kept at once in
a graph-structured stack.  Every row is deleted, kept or given another role, after any number of
inserted turns; readings with equal stack tops are merged, the smaller (cost, audit) stays.  So at
most four readings are alive, whatever the length.

Costs: Keep 0, Rerole to user or assistant 2, Delete 3, Insert a user or assistant turn without text 2;
a truncated row that is not deleted adds 1.  Blank rows and repetitions have to be deleted.  The audit
names the edits by their initials in order; among cheapest repairs the one with the ASCII-least audit
is taken.

Audits are compared without being held: readings after the same row contain equally many row edits
and end with one, so none is a prefix of another, their order never changes again, and a rank per
reading is enough.  What all readings have in common is settled and written out, so a long
conversation passes as a stream; only where two readings stay apart to the end is all of it held.

Order of rows: turn (nulls first), then role and text.  Null roles and texts count as one space.
Rows without conv_id form one conversation.  Equal rows are counted before they are shuffled; the
first is judged, the others are repetitions.  Empty tables give no rows; other columns are ignored.
A conversation of many rows is one key, since its order and its hash run through all of its rows;
its faults and first occurrences are found before, dealt out by their text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"

ROLE_OF = {"u": "user", "a": "assistant"}
#: Stack top -> role initial -> stack top after shifting it.
SHIFT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "P"}, "P": {"u": "u"}}
ACCEPTED = ("", "P")
INSERT, DELETE, REROLE, CUT_OFF = 2, 3, 2, 1


def _insertions() -> dict[str, list[tuple[str, str]]]:
    """Stack top -> (initials inserted, top then); no top is visited twice, which would only cost."""
    out = {}
    for top in SHIFT:
        found, at, word = [("", top)], top, ""
        while True:
            role = "a" if at == "u" else "u"
            at, word = SHIFT[at][role], word + role
            if at in [t for _, t in found]:
                break
            found.append((word, at))
        out[top] = found
    return out


INSERTIONS = _insertions()

EDITS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("position", pa.int64()),
        ("edit", pa.string()),
        ("turn", pa.int64()),
        ("was", pa.string()),
        ("role", pa.string()),
        ("text", pa.string()),
        ("fault", pa.string()),
    ]
)
EDITS_DDL = (
    "conv_id long, position long, edit string, turn long, was string, role string, text string, fault string"
)
SUMMARY_DDL = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


# ---------------------------------------------------------------- rows


def filled(conversations: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its
    text, 2 takes the sentence ends out, 3 repeats it, 4 makes it a user's."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = filled(conversations)
    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = rows.withColumn("_fate", fate).where("_fate <> 0")
    text = F.when(F.col("_fate") == 1, F.lit("")).when(
        F.col("_fate") == 2, F.regexp_replace("text", r"[.!?]", "")
    )
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("_fate") == 3, 2).otherwise(1))).alias("_one"),
    ).drop("_one")


def with_faults(conversations: DataFrame) -> DataFrame:
    """Distinct rows with ``copies`` (how many there are), ``fault`` and ``again`` (role and text
    occur in an earlier turn)."""
    rows = filled(conversations).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    body = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(body == "", F.lit("blank")).when(
        ~F.substring(body, -1, 1).isin(*ENDS), F.lit("truncated")
    )
    rows = rows.select("*", F.md5("text").alias("digest"), fault.alias("fault"))
    # In a struct a null turn sorts first, and min() does not pass over it.
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    first = first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    joined = rows.join(
        first,
        F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")),
    )
    again = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return joined.select("conv_id", "turn", "role", "text", "copies", "fault", again.alias("again"))


# ---------------------------------------------------------------- the parser


class Reading:
    """The best way to one stack top.  ``chain`` links its edits back: (chain before, initials
    inserted, edit, role given, number of the row)."""

    __slots__ = ("cost", "rank", "chain")

    def __init__(self, cost: int, rank: int, chain):
        self.cost, self.rank, self.chain = cost, rank, chain


class Repair:
    """One conversation, row by row; ``settled`` edits leave as soon as all readings share them."""

    PATIENCE = 256

    def __init__(self):
        self.heads = {"": Reading(0, 0, None)}
        self.rows: dict[int, tuple] = {}  # rows some reading still has to decide on
        self.seen = 0
        self.limit = self.PATIENCE

    def add(self, turn, role: str, text: str, fault: str | None) -> list[tuple]:
        """Take one row; returns the edits that are settled by now."""
        must_go = fault in ("blank", "duplicate")
        extra = CUT_OFF if fault == "truncated" else 0
        initial = role[:1]
        best: dict[str, tuple] = {}

        def offer(top, cost, rank, audit, chain):
            known = best.get(top)
            if known is None or (cost, rank, audit) < known[:3]:
                best[top] = (cost, rank, audit, chain)

        n = self.seen
        for top, head in self.heads.items():
            for inserted, then in INSERTIONS[top]:
                cost = head.cost + INSERT * len(inserted)
                before = "I" * len(inserted)
                offer(then, cost + DELETE, head.rank, before + "D", (head.chain, inserted, "D", None, n))
                if must_go:
                    continue
                for c, after in SHIFT[then].items():
                    if c == initial:
                        offer(after, cost + extra, head.rank, before + "K", (head.chain, inserted, "K", role, n))
                    elif c in ROLE_OF:
                        chain = (head.chain, inserted, "R", ROLE_OF[c], n)
                        offer(after, cost + REROLE + extra, head.rank, before + "R", chain)
        # A list of pairs can go on as any other top can, at most one deleted system turn dearer, and
        # an open user turn after an insertion; what costs more than that can never win.
        most = min([best["P"][0]] * ("P" in best) + [best["u"][0] + INSERT] * ("u" in best), default=None)
        order = [t for t in best if most is None or best[t][0] <= most + DELETE]
        order.sort(key=lambda t: best[t][1:3])
        self.heads = {t: Reading(best[t][0], k, best[t][3]) for k, t in enumerate(order)}
        self.rows[n] = (turn, role, text, fault)
        self.seen += 1
        return self.settle() if len(self.rows) >= self.limit else []

    def settle(self) -> list[tuple]:
        """Edits that all readings have in common."""
        common = None
        for head in self.heads.values():
            ids, chain = {}, head.chain
            while chain is not None:
                if common is None or id(chain) in common:
                    ids[id(chain)] = chain
                chain = chain[0]
            common = ids
        last = max(common.values(), key=lambda c: c[4], default=None)
        if last is None:
            self.limit *= 2  # two readings stay apart: look again when there is twice as much
            return []
        out = self.edits(last)
        self.limit = max(self.PATIENCE, 2 * len(self.rows))
        # The settled part is cut off: rebuild the chains above it.
        for head in self.heads.values():
            above, chain = [], head.chain
            while chain is not last:
                above.append(chain)
                chain = chain[0]
            rebuilt = None
            for link in reversed(above):
                rebuilt = (rebuilt, *link[1:])
            head.chain = rebuilt
        self._share()
        return out

    def _share(self) -> None:
        """Chains that were rebuilt apart but are equal are made one again."""
        known: dict[tuple, tuple] = {}
        for head in self.heads.values():
            links, chain = [], head.chain
            while chain is not None:
                links.append(chain)
                chain = chain[0]
            shared = None
            for link in reversed(links):
                key = (id(shared), *link[1:])
                shared = known.setdefault(key, (shared, *link[1:]))
            head.chain = shared

    def edits(self, chain) -> list[tuple]:
        """(edit, turn, was, role, text, fault) of a chain, first edit first; its rows are let go."""
        links = []
        while chain is not None:
            links.append(chain)
            chain = chain[0]
        out = []
        for _, inserted, edit, given, n in reversed(links):
            out += [("I", None, None, ROLE_OF[c], "", None) for c in inserted]
            turn, role, text, fault = self.rows.pop(n)
            out.append((edit, turn, role, given, text, fault))
        return out

    def finish(self) -> list[tuple]:
        """The rest of the cheapest repair."""
        ends = [
            ((head.cost + INSERT * len(inserted), head.rank, "I" * len(inserted)), inserted, head)
            for top, head in self.heads.items()
            for inserted, then in INSERTIONS[top]
            if then in ACCEPTED
        ]
        _, inserted, head = min(ends, key=lambda e: e[0])
        return self.edits(head.chain) + [("I", None, None, ROLE_OF[c], "", None) for c in inserted]


def _records(batches):
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns])


def _batches(rows, schema: pa.Schema, size: int = 2000, most_chars: int = 4_000_000):
    """Arrow batches of at most ``size`` rows and about ``most_chars`` characters."""
    held, chars = [], 0

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema
        )

    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or chars >= most_chars:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


def _repaired(batches):
    """Rows sorted by conversation and turn -> rows of edits."""

    def rows():
        now, job, position = None, None, 0
        for conv_id, turn, role, text, copies, fault, again in _records(batches):
            if job is None or conv_id != now:
                if job is not None:
                    for e in job.finish():
                        yield (now, position, *e)
                        position += 1
                now, job, position = conv_id, Repair(), 0
            for k in range(copies):
                what = fault if fault == "blank" else "duplicate" if again or k else fault
                for e in job.add(turn, role, text, what):
                    yield (now, position, *e)
                    position += 1
        if job is not None:
            for e in job.finish():
                yield (now, position, *e)
                position += 1

    yield from _batches(rows(), EDITS)


def repair(conversations: DataFrame) -> DataFrame:
    """One row per edit, in order of ``position``: conv_id, position, edit (K, R, D or I), turn, was
    (role before, NULL of an insertion), role (role after, NULL of a deletion), text, fault.

    The repaired conversation is the rows that are not deleted.
    """
    rows = with_faults(conversations).repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.mapInArrow(_repaired, EDITS_DDL)


# ---------------------------------------------------------------- what a repair comes to


class Summary:
    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.audit: list[str] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = self.turns = 0
        self.low = self.high = self.before = None
        self.text, self.any = hashlib.sha256(), False

    def add(self, edit, turn, was, role, text, fault) -> None:
        self.audit.append(edit)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit != "I":
            if fault is not None:
                self.faults[fault] += 1
                self.cost += CUT_OFF if fault == "truncated" and edit != "D" else 0
            if self.before is not None and self.before[:1] + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = was
            if turn is not None and turn != self.high:  # turns come in order
                self.turns += 1
                self.low, self.high = turn if self.low is None else self.low, turn
        if edit != "D":
            self.text.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        found = [self.faults[f] for f in ("blank", "duplicate", "truncated")]
        return (self.conv_id, gaps, *found, self.illegal, self.cost, "".join(self.audit), self.text.hexdigest())


def _summaries(batches):
    types = [pa.int64()] * 7 + [pa.string()] * 2
    schema = pa.schema([(c.split()[0], t) for c, t in zip(SUMMARY_DDL.split(", "), types)])

    def rows():
        summary = None
        for conv_id, position, *edit in _records(batches):
            if summary is None or conv_id != summary.conv_id:
                if summary is not None:
                    yield summary.row()
                summary = Summary(conv_id)
            if position >= 0:
                summary.add(*edit)
        if summary is not None:
            yield summary.row()

    yield from _batches(rows(), schema)


def summarize(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations``, with rows or without any left: gaps between its
    turns, its faults, pairs of roles that may not follow each other, and the repair's cost, audit and
    hash of ``role:text`` lines.  Streams over the edits in order; holds no conversation."""
    named = conversations.select(F.col("conv_id").cast("long")).distinct()
    marks = named.select("conv_id", *[
        (F.lit(-1) if f.name == "position" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in edits.schema if f.name != "conv_id"
    ])
    rows = edits.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return rows.mapInArrow(_summaries, SUMMARY_DDL)
