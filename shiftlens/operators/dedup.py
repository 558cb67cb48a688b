"""De-duplication of activities.

Rows are taken in insertion order (``id``).  A row is an exact duplicate when a row that was
*kept* has the same employee, start, duration and ticket.  Otherwise it is compared with the
kept rows of the same employee and near in time: with A, B, C each near the next only, B falls
to A and C stays, because B is no longer there.  A row that is merged into a kept row may
lengthen that row's description; later rows are compared with the new one.  A copy of a row
that fell to another one finds no kept twin, so it is compared again, at its own turn.

That rule looks sequential, but only nearby rows of one employee (and, for the scored
comparison, of one ticket) depend on each other.  So:

1. exact copies collapse to their first row with an aggregation (map-side combine).  Where that
   row was not kept, its copies collapse to the first row of each run: rows with one key and one
   text between two changes of the kept rows nearby (a row kept, a text lengthened) meet the same
   kept rows, so the first decides for all.  Runs are cut anew until they agree with the changes;
2. rows are cut into short time chunks and each chunk is decided on its own, with a fold that
   holds the kept rows of the chunk only; no pairs are materialised;
3. rows near a chunk border can depend on the chunk next door.  Chunks whose rows come within
   the window of each other across a border are decided again, each seeing what happened to the
   kept rows at its neighbour's side (kept at this id, rewritten at that id); from then on only
   chunks whose neighbour changed at the border are, until none does.  Every row depends on
   earlier rows only, so this ends, and it ends with exactly the sequential result.

A chunk holds rows of one employee and a fixed span of time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.operators.groups import attach_group
from shiftlens.session import cut_lineage

HASH_KEYS = ["employee_id", "start_ts", "duration_hours", "ticket_id"]


def activity_hash(
    employee: str = "employee_id",
    start: str = "start_ts",
    duration: str = "duration_hours",
    ticket: str = "ticket_id",
) -> Column:
    """md5 over the identifying fields; a missing field counts as empty text."""
    parts = [
        F.col(employee).cast("string"),
        F.date_format(start, "yyyy-MM-dd HH:mm:ss"),
        F.col(duration).cast("string"),
        F.col(ticket).cast("string"),
    ]
    return F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]))


@dataclass(frozen=True)
class DedupRules:
    """``window_minutes`` around a start, the score from which rows count as duplicates,
    the score above which they are merged, and whether exact copies are kept and flagged
    (``soft``) or left out.  ``compare_bytes`` limits the text comparison to the first
    bytes of each description; by default whole texts are compared."""

    window_minutes: int = 3
    threshold: float = 0.85
    merge_above: float = 0.9
    soft: bool = True
    compare_bytes: int | None = None
    chunk_minutes: int = 60

    @property
    def block(self) -> list[str]:
        # duration and text alone reach 0.7, so above that the tickets must be equal
        return ["employee_id", "ticket_id"] if self.threshold > 0.7 else ["employee_id"]


# Weights of the similarity score.
W_DURATION, W_TEXT, W_TICKET = 0.3, 0.4, 0.3


def _text_bytes(description: str, limit: int | None) -> str:
    """SQL text: one character per byte, so distances and lengths count bytes."""
    text = f"decode(encode(lower(trim({description})), 'UTF-8'), 'ISO-8859-1')"
    return text if limit is None else f"left({text}, {limit})"


def similarity_sql(a: str, b: str, least_text: float = 0.0) -> str:
    """Weighted similarity of two rows with fields dur, txt, len and tic; a part that is
    missing on either side scores 0.  A text similarity under ``least_text`` may count as 0,
    so that the distance of texts too far apart need not be finished."""
    duration = (
        f"case when {a}.dur > 0 and {b}.dur > 0 then greatest(0D, 1D - abs({a}.dur - {b}.dur) "
        f"/ greatest({a}.dur, {b}.dur) * 10D) else 0D end"
    )
    longest = f"greatest({a}.len, {b}.len)"
    most = f"cast(ceil({1 - least_text}D * {longest}) as int) + 1"
    distance = f"levenshtein({a}.txt, {b}.txt, {most})"
    text = (
        f"case when {a}.len > 0 and {b}.len > 0 then case when {a}.txt = {b}.txt and {a}.len = {b}.len "
        f"then 1D else greatest(0D, 1D - cast(case when {distance} < 0 then {longest} else {distance} end as double) / "
        f"cast({longest} as double)) end else 0D end"
    )
    ticket = f"case when {a}.tic = {b}.tic then 1D else 0D end"
    return (
        f"least(1D, ({duration}) * {W_DURATION}D + ({text}) * {W_TEXT}D + ({ticket}) * {W_TICKET}D)"
    )


def _score_match(rules: DedupRules) -> tuple[str, str]:
    """(condition, score) for lambda variables k, the kept row, and r.  The duration is
    tested first: it is cheap and rules most pairs out before any text distance."""
    least_text = max(0.0, (rules.threshold - W_DURATION - W_TICKET) / W_TEXT - 1e-9)
    score = similarity_sql("r", "k", least_text)
    need = (rules.threshold - W_TEXT - W_TICKET) / W_DURATION - 1e-9
    near = f"abs(r.s - k.s) <= {rules.window_minutes * 60}"
    alike = f"abs(r.dur - k.dur) * 10D <= (1D - {need}D) * greatest(r.dur, k.dur)" if need > 0 else "true"
    condition = f"{near} and {alike} and {score} >= {rules.threshold}D"
    return condition, score


ROW = ["at", "kind", "id", "s", "dur", "txt", "len", "tic", "twin"]
HIT = "cast(null as struct<gap: bigint, id: bigint, score: double, exact: boolean>)"


def _decide(chunks: DataFrame, block: list[str], condition: str, score: str, merge_above: float | None) -> DataFrame:
    """Decide the rows of every chunk.  Rows of kind 1 are news from a neighbour: the state of
    one of its kept rows as of ``at``; they are not decided here.

    One fold over the rows in order of ``at`` holds the kept rows so far and the decisions:
    ``hit``, the kept row a row falls to, and ``changed``, that row after a merge that rewrote it.
    """
    rows = chunks.groupBy(*block, "chunk").agg(F.sort_array(F.collect_list(F.struct(*ROW))).alias("rows"))
    twin = "array_min(transform(filter(acc.kept, k -> k.twin = r.twin), k -> k.id))"
    best = (
        f"array_min(transform(filter(acc.kept, k -> {condition}), "
        f"k -> named_struct('gap', abs(r.s - k.s) div 60, 'id', k.id, 'score', {score}, 'exact', false)))"
    )
    hit = f"coalesce(case when {twin} is not null then named_struct('gap', 0L, 'id', {twin}, 'score', 1D, 'exact', true) end, {best})"
    changed = (
        "get(transform(filter(acc.kept, k -> k.id = h.id and (coalesce(r.len > coalesce(k.len, 0), false) "
        "or (k.tic is null and r.tic is not null))), k -> named_struct('at', r.at, 'kind', 1, 'id', k.id, "
        "'s', k.s, 'dur', k.dur, 'txt', case when r.len > coalesce(k.len, 0) then r.txt else k.txt end, "
        "'len', case when r.len > coalesce(k.len, 0) then r.len else k.len end, "
        "'tic', coalesce(r.tic, k.tic), 'twin', k.twin)), 0)"
    )
    merges = f"h is not null and not h.exact and h.score > {merge_above}D" if merge_above is not None else "false"
    none = "case when false then rows[0] end"
    decision = "named_struct('row', r, 'hit', h, 'changed', c)"
    start = (
        "named_struct('kept', filter(rows, x -> false), 'decided', "
        f"transform(filter(rows, x -> false), x -> named_struct('row', x, 'hit', {HIT}, 'changed', case when x.kind = 1 then x end)))"
    )
    own = (
        f"element_at(transform(array({hit}), h -> element_at(transform(array(case when {merges} then {changed} else {none} end), "
        "c -> named_struct("
        "'kept', case when h is null then array_append(acc.kept, r) "
        "when c is not null then transform(acc.kept, k -> case when k.id = c.id then c else k end) else acc.kept end, "
        f"'decided', array_append(acc.decided, {decision}))), 1)), 1)"
    )
    news = (
        "named_struct('kept', array_append(filter(acc.kept, k -> k.id <> r.id), r), 'decided', acc.decided)"
    )
    decided = rows.select(
        *block,
        "chunk",
        F.explode(
            F.expr(
                f"aggregate(rows, {start}, (acc, r) -> case when r.kind = 1 then {news} else {own} end, acc -> acc.decided)"
            )
        ).alias("o"),
    )
    return decided.select(*block, "chunk", "o.row.*", "o.hit", "o.changed")


def greedy_matches(
    rows: DataFrame,
    block: list[str],
    window_s: int,
    condition: str,
    score: str,
    chunk_s: int,
    merge_above: float | None = None,
) -> DataFrame:
    """``rows`` (block, id, s, dur, txt, len, tic, twin) plus ``hit``: the kept row each row
    falls to (gap, id, score, exact), NULL for kept rows.

    Starts a job that looks for chunks that meet at a border, and a few per round when there
    are some.
    """
    if chunk_s <= 2 * window_s:
        raise ValueError("a chunk must be more than twice as long as the comparison window")
    rows = rows.select(
        *block, F.expr(f"s div {chunk_s}").alias("chunk"), F.col("id").alias("at"), F.lit(0).alias("kind"), *ROW[2:]
    )

    def border_of(s: str) -> Column:
        # Border b lies before chunk b: rows of chunk b near its start, of chunk b - 1 near its end.
        offset = F.expr(f"{s} - {s} div {chunk_s} * {chunk_s}")
        return F.when(offset <= window_s, F.expr(f"{s} div {chunk_s}")).when(
            offset >= chunk_s - window_s, F.expr(f"{s} div {chunk_s} + 1")
        )

    at_border = rows.withColumn("border", border_of("s")).where("border is not null")
    live = (
        at_border.groupBy(*block, "border")
        .agg(
            F.min(F.when(F.col("chunk") == F.col("border"), F.col("s"))).alias("after"),
            F.max(F.when(F.col("chunk") < F.col("border"), F.col("s"))).alias("before"),
        )
        .where(F.col("after") - F.col("before") <= window_s)
    )
    touching = live.select(*block, F.explode(F.expr("array(border - 1, border)")).alias("chunk"))
    linked = cut_lineage(rows.join(touching.distinct(), [*block, "chunk"], "left_semi"))
    if linked.isEmpty():
        return _decide(rows, block, condition, score, merge_above)
    chunk_key = [*block, "chunk"]
    active = linked.select(*chunk_key).distinct()
    alone = rows.join(active, chunk_key, "left_anti")

    def news_of(decided: DataFrame) -> DataFrame:
        """What a chunk did to kept rows at its borders: (block, chunk, border, row as of at)."""
        kept = decided.where("hit is null").select(*chunk_key, *ROW)
        rewritten = decided.where("changed is not null").select(*chunk_key, "changed.*")
        return kept.unionByName(rewritten).withColumn("border", border_of("s")).where("border is not null")

    current = cut_lineage(_decide(linked, block, condition, score, merge_above))
    while not active.isEmpty():
        halo = (
            news_of(current)
            .withColumn("chunk", F.expr("border + border - 1 - chunk"))
            .drop("border")
            .withColumn("kind", F.lit(1))
            .join(active, chunk_key, "left_semi")
        )
        again = linked.join(active, chunk_key, "left_semi")
        redone = cut_lineage(_decide(again.unionByName(halo), block, condition, score, merge_above))
        replaced = current.join(active, chunk_key, "left_semi")
        marks = [*chunk_key, "border", "id", "at", "txt", "len", "tic"]
        before = news_of(replaced).select(*marks, F.lit(1).alias("side"))
        after = news_of(redone).select(*marks, F.lit(-1).alias("side"))
        differs = before.unionByName(after).groupBy(*marks).agg(F.sum("side").alias("side")).where("side <> 0")
        current = cut_lineage(current.join(active, chunk_key, "left_anti").unionByName(redone))
        next_door = F.expr("border + border - 1 - chunk").alias("chunk")
        active = cut_lineage(differs.select(*block, next_door).distinct())
    return _decide(alone, block, condition, score, merge_above).unionByName(current)


RUN = ["first_id", "txt", "len", "run"]


def _changes_nearby(groups: DataFrame, decided: DataFrame, rules: DedupRules) -> DataFrame:
    """``groups`` of exact copies (HASH_KEYS, first_id, s, twin) with ``changes``, the sorted ids at
    which kept rows within the window of them were added or rewritten, and ``kept_id``, the kept
    row with their own key."""
    window = rules.window_minutes * 60
    added = decided.where("hit is null").select(*rules.block, "s", F.col("id").alias("at"), "twin")
    rewritten = decided.where("changed is not null").select(
        *rules.block, "changed.s", "changed.at", F.lit(None).cast("long").alias("twin")
    )
    names = {c: f"e_{c}" for c in [*rules.block, "s", "twin"]}
    events = added.unionByName(rewritten).withColumnsRenamed(names)
    events = events.withColumn("e_part", F.explode(F.expr(f"transform(array(-1, 0, 1), d -> e_s div {window + 1} + d)")))
    near = (F.col("e_part") == F.expr(f"s div {window + 1}")) & (F.abs(F.col("s") - F.col("e_s")) <= window)
    for c in rules.block:
        near = near & (F.col(c) == F.col(f"e_{c}"))
    return (
        groups.join(events, near)
        .groupBy(*HASH_KEYS, "first_id")
        .agg(
            F.array_sort(F.collect_set("at")).alias("changes"),
            F.min(F.when(F.col("e_twin") == F.col("twin"), F.col("at"))).alias("kept_id"),
        )
    )


def _members_of_runs(keyed: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of the groups up to their kept row, with ``run``, the number of changes before them."""
    members = attach_group(keyed, HASH_KEYS, changes).where("first_id is not null and id <= coalesce(kept_id, id)")
    return members.withColumn("run", F.expr("size(filter(changes, c -> c < id))")).drop("changes", "kept_id")


def find_duplicates(activities: DataFrame, rules: DedupRules | None = None) -> DataFrame:
    """One decision per activity.

    Columns: id, activity_hash, action (insert, mark, merge, skip), duplicate_type,
    original_id, confidence, minutes_apart.  ``original_id`` is always a kept row.
    """
    rules = rules or DedupRules()
    text = _text_bytes("description", rules.compare_bytes)
    fields = ["id", "s", "dur", "txt", "len", "tic"]
    keyed = activities.select(
        *HASH_KEYS,
        "id",
        F.unix_timestamp("start_ts").alias("s"),
        F.col("duration_hours").cast("double").alias("dur"),
        F.expr(text).alias("txt"),
        F.expr("octet_length(trim(description))").alias("len"),
        F.nullif(F.col("ticket_id").cast("string"), F.lit("0")).alias("tic"),
    )
    first = cut_lineage(
        keyed.groupBy(*HASH_KEYS)
        .agg(F.min(F.struct(*fields)).alias("f"), F.count(F.lit(1)).alias("n"))
        .select(*HASH_KEYS, "f.*", "n")
    )
    comparable = F.col("employee_id").isNotNull() & F.col("start_ts").isNotNull()
    if "ticket_id" in rules.block:
        comparable = comparable & F.col("tic").isNotNull()
    condition, score = _score_match(rules)
    own = ["id", "s", "dur", "txt", "len", "tic", F.xxhash64(*HASH_KEYS).alias("twin")]

    def decided(rows: DataFrame) -> DataFrame:
        return greedy_matches(
            rows.where(comparable).select(*rules.block, *own),
            rules.block,
            rules.window_minutes * 60,
            condition,
            score,
            max(60 * rules.chunk_minutes, 120 * rules.window_minutes + 1),
            rules.merge_above,
        )

    # Copies of a kept row fall to it.  Of the copies of first rows that were not kept, the first of
    # each run takes part, and may change which other rows are kept; so until no new ones turn up.
    repeated = first.where(comparable & (F.col("n") > 1)).select(*HASH_KEYS, F.col("id").alias("first_id"), "s", own[-1])
    taking_part = first.select(*HASH_KEYS, *fields)
    while True:
        out = cut_lineage(decided(taking_part).select(*rules.block, "id", "s", "twin", "hit", "changed"))
        fallen = repeated.join(out.where("hit is not null").select(F.col("id").alias("first_id")), "first_id", "left_semi")
        changes = cut_lineage(_changes_nearby(fallen, out, rules))
        members = _members_of_runs(keyed, changes)
        runs = cut_lineage(members.groupBy(*RUN).agg(F.min(F.struct(*HASH_KEYS, *fields)).alias("f")))
        firsts = runs.select("f.*")
        more = cut_lineage(firsts.join(out.select("id"), "id", "left_anti").select(*taking_part.columns))
        if more.isEmpty():
            break
        taking_part = cut_lineage(taking_part.unionByName(more))
    # Rows that took part, and rows for which the first of their run did.
    part = out.select(F.col("id").alias("m_id"), "hit")
    stands_for = runs.select(*RUN, F.col("f.id").alias("run_id"))
    others = attach_group(members.select(*RUN, "id"), RUN, stands_for).select("id", "run_id")
    others = others.join(out.select("id"), "id", "left_anti")
    others = others.join(part.withColumnRenamed("m_id", "run_id"), "run_id").select(F.col("id").alias("m_id"), "hit")
    part = part.unionByName(others).withColumn("decided_here", F.lit(True))
    kept = changes.select("first_id", "kept_id")
    groups = first.select(*HASH_KEYS, F.col("id").alias("first_id")).join(kept, "first_id", "left")
    rows = activities.select(*HASH_KEYS, "id", activity_hash().alias("activity_hash"))
    joined = attach_group(rows, HASH_KEYS, groups)
    # A copy that was not decided falls to the kept row with its key.
    joined = joined.join(part, joined["id"] == part["m_id"], "left")
    plain_copy = F.col("decided_here").isNull() & (F.col("id") != F.col("first_id"))
    exact = plain_copy | F.coalesce(F.col("hit.exact"), F.lit(False))
    near = F.col("hit").isNotNull() & ~exact
    return joined.select(
        "id",
        "activity_hash",
        F.when(exact, "mark" if rules.soft else "skip")
        .when(near & (F.col("hit.score") > rules.merge_above), "merge")
        .when(near, "mark")
        .otherwise("insert")
        .alias("action"),
        F.when(exact, "exact").when(near, "near").alias("duplicate_type"),
        F.when(plain_copy, F.coalesce("kept_id", "first_id")).otherwise(F.col("hit.id")).alias("original_id"),
        F.when(exact, F.lit(1.0)).when(near, F.col("hit.score")).alias("confidence"),
        F.when(near, F.col("hit.gap")).alias("minutes_apart"),
    )


def apply_decisions(
    activities: DataFrame, decisions: DataFrame, row_id: str = "id"
) -> DataFrame:
    """The stored table after the decisions: inserted rows, flagged rows with their
    original, and originals refreshed by the rows merged into them."""
    d = decisions.select(
        F.col("id").alias("d_id"), "activity_hash", "action", "original_id", "confidence", "duplicate_type"
    )
    joined = activities.join(d, activities[row_id] == d["d_id"]).drop("d_id")
    merged = merged_originals(activities, decisions).select(
        F.col("id").alias("m_id"), F.col("description").alias("m_text"), F.col("ticket_id").alias("m_ticket")
    )
    stored = joined.where(~F.col("action").isin("merge", "skip"))
    out = stored.join(merged, stored[row_id] == merged["m_id"], "left")
    dup = F.col("action") == "mark"
    return out.select(
        *[
            F.coalesce("m_text", c).alias(c) if c == "description"
            else F.coalesce("m_ticket", c).alias(c) if c == "ticket_id"
            else F.col(c)
            for c in activities.columns
        ],
        "activity_hash",
        dup.alias("is_duplicate"),
        F.when(dup, F.col("original_id")).alias("original_id"),
        F.when(dup, F.concat("duplicate_type", F.lit(" duplicate"))).alias("duplicate_reason"),
        F.when(dup, F.col("confidence")).alias("confidence"),
    )


def merged_originals(activities: DataFrame, decisions: DataFrame) -> DataFrame:
    """What each original that takes merges becomes: the longest description (the earlier
    one on a tie) and the newest ticket that is not empty."""
    merges = decisions.where("action = 'merge'").select(
        F.col("id").alias("m_id"), F.col("original_id").alias("target")
    )
    texts = activities.select("id", "description", F.col("ticket_id"))
    incoming = merges.join(texts, merges["m_id"] == texts["id"]).select(
        "target", "id", "description", "ticket_id"
    )
    targets = incoming.select("target").distinct()
    own = texts.join(targets, texts["id"] == targets["target"]).select(
        "target", F.lit(-1).cast("bigint").alias("id"), "description", "ticket_id"
    )
    size = F.coalesce(F.octet_length(F.trim("description")), F.lit(0))
    ticket = F.when(F.col("ticket_id").cast("string") != "0", F.col("ticket_id"))
    return (
        own.unionByName(incoming)
        .groupBy("target")
        .agg(
            F.max_by(F.trim("description"), F.struct(size, -F.col("id"))).alias("description"),
            F.max_by(ticket, F.when(ticket.isNotNull(), F.col("id"))).alias("ticket_id"),
            (F.count(F.lit(1)) - 1).alias("merged"),
        )
        .withColumnRenamed("target", "id")
    )


def near_repeats(
    activities: DataFrame,
    window_minutes: int = 3,
    max_gap_hours: float = 0.1,
    chunk_minutes: int = 60,
) -> DataFrame:
    """The simple rule: dropped when a kept activity of the employee starts within so many
    whole minutes and its duration differs by less than the gap.  Columns: id, original_id
    of the dropped rows."""
    keys = ["employee_id", "start_ts", "duration_hours"]
    first = (
        activities.where("employee_id is not null and start_ts is not null")
        .groupBy(*keys)
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        .select(
            *keys,
            "id",
            F.unix_timestamp("start_ts").alias("s"),
            F.col("duration_hours").cast("double").alias("dur"),
            F.lit("").alias("txt"),
            F.lit(0).alias("len"),
            F.lit("").alias("tic"),
            F.col("id").alias("twin"),
            "n",
        )
    )
    window = (window_minutes + 1) * 60 - 1
    condition = f"abs(r.s - k.s) <= {window} and abs(r.dur - k.dur) < {max_gap_hours}D"
    fields = ["id", "s", "dur", "txt", "len", "tic", "twin"]
    matched = greedy_matches(
        first.select("employee_id", *fields), ["employee_id"], window, condition, "1D",
        max(chunk_minutes * 60, 2 * window + 1),
    ).where("hit is not null")
    matched = matched.select(F.col("id").alias("m_id"), F.col("hit.id").alias("best_id"))
    groups = first.join(matched, first["id"] == matched["m_id"], "left").select(
        *keys, F.col("id").alias("first_id"), "best_id"
    )
    rows = activities.select(*keys, "id")
    joined = attach_group(rows, keys, groups)
    copy = F.col("id") != F.col("first_id")
    return joined.select(
        "id", F.coalesce("best_id", F.when(copy, F.col("first_id"))).alias("original_id")
    ).where("original_id is not null")


def decision_counts(decisions: DataFrame) -> DataFrame:
    """Session statistics: duplicates found, merged, flagged, skipped, and rows inserted."""

    def times(condition: str) -> Column:
        return F.count(F.when(F.expr(condition), F.lit(1)))

    return decisions.agg(
        times("action <> 'insert'").alias("duplicates_detected"),
        times("action = 'merge'").alias("duplicates_merged"),
        times("action = 'mark'").alias("duplicates_marked"),
        times("action = 'skip'").alias("duplicates_skipped"),
        times("action = 'insert'").alias("unique_inserted"),
    )


def suspect_days(activities: DataFrame, more_than: int = 3, day: Column | None = None) -> DataFrame:
    """How many (employee, day) have more activities than that."""
    day = F.to_date("start_ts") if day is None else day
    busy = (
        activities.groupBy("employee_id", day.alias("work_date"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > more_than)
    )
    return busy.agg(F.count(F.lit(1)).alias("suspect_days"))
