"""Near-duplicate guard on a stream of activities.

Keyed state holds the kept activities of one (employee, ticket) whose start the watermark has not yet
left behind by more than the comparison window.  Rows are decided in order of their ids within a
batch, and the batches in order of arrival, by the rule of ``operators.dedup``: an exact copy of a
kept row is marked, a row near a kept one and alike enough is marked or merged, and a merge may
lengthen the kept row's text.  A timer on the event time drops what nothing can be compared with any
more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shiftlens.operators.dedup import W_DURATION, W_TEXT, W_TICKET, DedupRules, _text_bytes, activity_hash

KEPT = "ids array<bigint>, at array<bigint>, durations array<double>, texts array<string>, sizes array<int>, tickets array<string>, hashes array<string>"
DECISION = (
    "id bigint, activity_hash string, action string, duplicate_type string, original_id bigint, confidence double, minutes_apart bigint"
)


def edit_distance(a: str, b: str) -> int:
    if a == b:
        return 0
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1]


def similarity(a: dict, b: dict) -> float:
    """Weighted similarity of two rows, as the batch operator scores it."""
    duration = text = 0.0
    if a["dur"] is not None and b["dur"] is not None and a["dur"] > 0 and b["dur"] > 0:
        duration = max(0.0, 1.0 - abs(a["dur"] - b["dur"]) / max(a["dur"], b["dur"]) * 10.0)
    if a["len"] and b["len"]:
        if a["txt"] == b["txt"] and a["len"] == b["len"]:
            text = 1.0
        else:
            text = max(0.0, 1.0 - edit_distance(a["txt"], b["txt"]) / max(a["len"], b["len"]))
    ticket = 1.0 if a["tic"] is not None and a["tic"] == b["tic"] else 0.0
    return min(1.0, duration * W_DURATION + text * W_TEXT + ticket * W_TICKET)


def decide(row: dict, kept: list[dict], rules: DedupRules) -> tuple:
    """What becomes of a row; ``kept`` takes it in, or the text it adds to a kept one."""
    twins = [k["id"] for k in kept if k["hash"] == row["hash"]]
    if twins:
        return row["id"], row["hash"], "mark" if rules.soft else "skip", "exact", min(twins), 1.0, None
    near = []
    if row["s"] is not None and row["tic"] is not None:
        for k in kept:
            if abs(row["s"] - k["s"]) <= rules.window_minutes * 60:
                score = similarity(row, k)
                if score >= rules.threshold:
                    near.append((abs(row["s"] - k["s"]) // 60, k["id"], score))
    if not near:
        kept.append(row)
        return row["id"], row["hash"], "insert", None, None, None, None
    gap, original, score = min(near)
    merges = score > rules.merge_above
    if merges:
        for k in kept:
            if k["id"] == original and (row["len"] or 0) > (k["len"] or 0):
                k["txt"], k["len"] = row["txt"], row["len"]
    return row["id"], row["hash"], "merge" if merges else "mark", "near", original, score, int(gap)


def guarded(activities: DataFrame, rules: DedupRules | None = None, lateness: str = "1 day") -> DataFrame:
    """One decision per arriving activity, with the columns of ``dedup.find_duplicates``.

    ``activities`` is a stream with id, employee_id, start_ts, duration_hours, ticket_id and
    description.  Rows that come later than the watermark, the latest start seen less ``lateness``,
    are left out.  The threshold has to be above 0.7, so that only equal tickets can be alike.
    """
    rules = rules or DedupRules()
    if rules.threshold <= 0.7:
        raise ValueError("below 0.7 rows of different tickets can be alike; they are not in one state here")
    keyed = activities.where("start_ts is not null").select(
        "id",
        "start_ts",
        "employee_id",
        F.nullif(F.col("ticket_id").cast("string"), F.lit("0")).alias("tic"),
        F.unix_timestamp("start_ts").alias("s"),
        F.col("duration_hours").cast("double").alias("dur"),
        F.expr(_text_bytes("description", rules.compare_bytes)).alias("txt"),
        F.expr("octet_length(trim(description))").alias("len"),
        activity_hash().alias("hash"),
    )
    window = rules.window_minutes * 60

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["id", "s", "dur", "txt", "len", "tic", "hash"]
        kept = [dict(zip(names, values)) for values in zip(*state.get)] if state.exists else []
        watermark = state.getCurrentWatermarkMs() // 1000
        kept = [k for k in kept if k["s"] + window >= watermark]
        if state.hasTimedOut:
            state.remove()
        else:
            rows = pd.concat(list(batches)).astype(object)
            rows = rows.where(rows.notna(), None).sort_values("id")
            decisions = []
            for r in rows[names].to_dict("records"):
                r["len"] = None if r["len"] is None else int(r["len"])  # pandas reads integers with gaps as floats
                decisions.append(decide(r, kept, rules))
            out = pd.DataFrame(decisions, columns=[c.split()[0] for c in DECISION.split(", ")]).astype(object)
            out["original_id"] = out["original_id"].astype("Int64")
            out["minutes_apart"] = out["minutes_apart"].astype("Int64")
            yield out
        if kept:
            state.update(tuple([k[n] for k in kept] for n in names))
            state.setTimeoutTimestamp((max(max(k["s"] for k in kept) + window, watermark) + 1) * 1000)
        elif state.exists and not state.hasTimedOut:
            state.remove()

    return (
        keyed.withWatermark("start_ts", lateness)
        .groupBy("employee_id", "tic")
        .applyInPandasWithState(step, DECISION, KEPT, "append", GroupStateTimeout.EventTimeTimeout)
    )
