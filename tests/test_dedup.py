"""The duplicate rules against a sequential loop, across chunk borders and with hot keys."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest

from conftest import rows
from shiftlens.operators import dedup as DD, groups as G

SCHEMA = (
    "id long, employee_id long, ticket_id int, start_ts timestamp, end_ts timestamp, "
    "duration_hours decimal(5,2), description string"
)
BASE = dt.datetime(2025, 6, 3, 8)


def lev(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def score(r, k):
    d1, d2 = float(r[5]), float(k[5])
    s = max(0.0, 1 - abs(d1 - d2) / max(d1, d2) * 10) * 0.3
    a, b = (r[6] or "").strip().lower().encode(), (k[6] or "").strip().lower().encode()
    if a and b:
        s += max(0.0, 1 - lev(a, b) / max(len(a), len(b))) * 0.4
    if r[2] and r[2] == k[2]:
        s += 0.3
    return min(1.0, s)


def sequential(data, window, threshold, merge_above=0.9):
    """id -> (kind, original) by the row-at-a-time rule: an exact match with a stored row that is
    not a duplicate, else the nearest stored row that is similar enough; merging may lengthen the
    stored description, and later rows meet the new one."""
    kept, out = {}, {}
    for r in sorted(data):
        key = (r[1], r[3], r[5], r[2])
        twins = [i for i, k in kept.items() if (k[1], k[3], k[5], k[2]) == key]
        if twins:
            out[r[0]] = ("exact", min(twins))
            continue
        near = [
            (int(abs((r[3] - k[3]).total_seconds())) // 60, i, score(r, k))
            for i, k in kept.items()
            if k[1] == r[1] and abs((r[3] - k[3]).total_seconds()) <= window * 60 and score(r, k) >= threshold
        ]
        if near and r[2]:
            _, target, s = min(near)
            out[r[0]] = ("near", target)
            old, new = (kept[target][6] or "").strip(), (r[6] or "").strip()
            if s > merge_above and len(new.encode()) > len(old.encode()):
                kept[target] = (*kept[target][:6], new)
        else:
            out[r[0]] = (None, None)
            kept[r[0]] = r
    return out


def made(seed, n=120, minutes=200):
    rnd = random.Random(seed)
    texts = ["controllo del server di posta", "controllo del server di poste", "controllo del server di posta e",
             "controllo del server di posta ex", "controllo del server di posta exch", "perché non stampa", "perche non stampa", None]
    out = []
    for i in range(n):
        start = BASE + dt.timedelta(seconds=rnd.randrange(minutes * 60) // 20 * 20)
        out.append((i, rnd.choice([1, 1, 2]), rnd.choice([5, 5, 6, None]), start, start, D(rnd.choice(["1.00", "1.02", "2.00"])), rnd.choice(texts)))
    return out + [(n + i, *r[1:]) for i, r in enumerate(rnd.sample(out, 20))]


@pytest.mark.parametrize("seed,chunk", [(1, 6), (2, 60), (3, 7), (4, 6)])
def test_equals_the_sequential_rule(spark, seed, chunk):
    data = made(seed)
    rules = DD.DedupRules(window_minutes=3, threshold=0.85, chunk_minutes=chunk)
    got = {
        r.id: (r.duplicate_type, r.original_id)
        for r in DD.find_duplicates(spark.createDataFrame(data, SCHEMA), rules).collect()
    }
    assert got == sequential(data, 3, 0.85)


def near_row(i, minutes, text, hours="1.00"):
    return (i, 1, 5, BASE + dt.timedelta(minutes=minutes), BASE, D(hours), text)


@pytest.mark.parametrize("chunk", [6, 60])
def test_copy_of_a_merged_row_is_compared_itself(spark, chunk):
    data = [near_row(1, 0, "controllo posta"), near_row(2, 1, "controllo posta"), near_row(3, 1, "controllo posta"),
            near_row(4, 1, "tutto altro lavoro"), near_row(5, 1, "tutto altro lavoro")]
    rules = DD.DedupRules(chunk_minutes=chunk)
    got = {r.id: (r.action, r.duplicate_type, r.original_id) for r in DD.find_duplicates(spark.createDataFrame(data, SCHEMA), rules).collect()}
    assert got == {1: ("insert", None, None), 2: ("merge", "near", 1), 3: ("merge", "near", 1),
                   4: ("insert", None, None), 5: ("mark", "exact", 4)}


@pytest.mark.parametrize("seed,chunk", [(1, 60), (2, 6)])
def test_many_copies_of_a_merged_row_collapse(spark, monkeypatch, seed, chunk):
    rnd = random.Random(seed)
    other = ["controllo posta", "controllo posta e", "tutto altro lavoro", None]
    data = [near_row(1, 2, "controllo posta"), near_row(2, 3, "controllo posta")]
    data += [near_row(i, 3, "controllo posta") for i in range(3, 1500)]
    data += [near_row(i, rnd.choice([2, 3, 4, 5, 7]), rnd.choice(other)) for i in range(1500, 1560)]
    data += [near_row(i, 3, rnd.choice(["controllo posta", "controllo posta ex"])) for i in range(1560, 2200)]
    most, fold = [], DD._decide

    def counted(chunks, block, *rest):
        most.append(chunks.groupBy(*block, "chunk").count().agg({"count": "max"}).first()[0] or 0)
        return fold(chunks, block, *rest)

    monkeypatch.setattr(DD, "_decide", counted)
    got = DD.find_duplicates(spark.createDataFrame(data, SCHEMA), DD.DedupRules(chunk_minutes=chunk)).collect()
    assert {r.id: (r.duplicate_type, r.original_id) for r in got} == sequential(data, 3, 0.85)
    assert max(most) < 100


@pytest.mark.parametrize("seed", [5, 6])
def test_copies_with_several_texts_equal_the_sequential_rule(spark, seed):
    rnd = random.Random(seed)
    data = made(seed, 60, 30)
    data += [(100 + i, *rnd.choice(data[:40])[1:6], rnd.choice(data)[6]) for i in range(400)]
    got = DD.find_duplicates(spark.createDataFrame(data, SCHEMA), DD.DedupRules(chunk_minutes=7)).collect()
    assert {r.id: (r.duplicate_type, r.original_id) for r in got} == sequential(data, 3, 0.85)


@pytest.mark.parametrize("start", [0, 58])
def test_later_rows_meet_the_merged_text(spark, start):
    # 3 is near the text that 2 brought (0.88), not near the first one (0.84); also across a border
    data = [near_row(1, start, "abcdefghij"), near_row(2, start + 1, "abcdefghijkl"), near_row(3, start + 2, "abcdefghijklmnopq")]
    got = {r.id: (r.action, r.original_id) for r in DD.find_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {1: ("insert", None), 2: ("merge", 1), 3: ("mark", 1)}


def test_one_very_busy_employee(spark):
    rnd = random.Random(8)
    texts = ["giro di controllo", "giro di controllo notturno", "altro"]
    data = [near_row(i, rnd.randrange(0, 2400) / 2, rnd.choice(texts), rnd.choice(["1.00", "1.02"])) for i in range(700)]
    got = {r.id: (r.duplicate_type, r.original_id) for r in DD.find_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == sequential(data, 3, 0.85)


def test_chain_across_chunk_borders(spark):
    # one row every two minutes for two hours: every second row falls to the one before
    data = [(i, 1, 5, BASE + dt.timedelta(minutes=2 * i), BASE, D("1.00"), "stesso testo") for i in range(60)]
    rules = DD.DedupRules(window_minutes=3, chunk_minutes=8)
    got = {r.id: r.original_id for r in DD.find_duplicates(spark.createDataFrame(data, SCHEMA), rules).collect()}
    assert got == {i: (None if i % 2 == 0 else i - 1) for i in range(60)}


def test_ticket_missing_confidence_and_merge(spark):
    t = BASE
    data = [
        (1, 1, 5, t, t, D("1.00"), "abcdefghij"),
        (2, 1, None, t + dt.timedelta(minutes=1), t, D("1.00"), "abcdefghij"),
        (3, 1, 5, t + dt.timedelta(minutes=1), t, D("1.00"), "abcdefghijk lungo"),
        (4, 1, 5, t + dt.timedelta(minutes=2), t, D("1.00"), "abcdefghik"),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    dec = DD.find_duplicates(df, DD.DedupRules(threshold=0.8))
    got = {r.id: (r.action, r.original_id) for r in dec.collect()}
    assert got == {1: ("insert", None), 2: ("insert", None), 3: ("mark", 1), 4: ("merge", 1)}
    merged = DD.merged_originals(df, dec).collect()
    assert [(r.id, r.description, r.ticket_id, r.merged) for r in merged] == [(1, "abcdefghij", 5, 1)]
    stored = {r.id: r.is_duplicate for r in DD.apply_decisions(df, dec).collect()}
    assert stored == {1: False, 2: False, 3: True}


def test_skip_mode_and_byte_distance(spark):
    t = BASE
    data = [(1, 1, 5, t, t, D("1.00"), "perché"), (2, 1, 5, t, t, D("1.00"), "altro"), (3, 1, 5, t + dt.timedelta(minutes=1), t, D("1.00"), "perche")]
    got = {r.id: r for r in DD.find_duplicates(spark.createDataFrame(data, SCHEMA), DD.DedupRules(soft=False)).collect()}
    assert got[2].action == "skip" and got[2].confidence == 1.0
    assert got[3].confidence == pytest.approx(0.6 + 0.4 * (1 - 2 / 7))


def test_simple_rule(spark):
    t = BASE

    def row(i, seconds, hours):
        return (i, 1, None, t + dt.timedelta(seconds=seconds), t, D(hours), None)

    data = [row(1, 0, "1.00"), row(2, 239, "1.09"), row(3, 240, "1.00"), row(4, 100, "1.10"), row(5, 0, "1.00")]
    got = rows(DD.near_repeats(spark.createDataFrame(data, SCHEMA)))
    assert got == [(2, 1), (5, 1)]


def test_copies_of_hot_and_null_keys(spark):
    df = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then null else id % 100 end as k", "1 as x")
    marked = rows(G.mark_duplicates(df, ["k", "x"]))
    assert all(r[3] == (r[4] is not None) and (r[4] is None or r[4] < r[0]) for r in marked)
    assert G.cleanup_counts(df, ["k", "x"]).first().marked == sum(1 for r in marked if r[3]) == 899


def test_marking_twice_changes_nothing(spark):
    df = spark.range(50).selectExpr("id", "id % 7 as k")
    kept = G.mark_duplicates(df, ["k"]).where("not is_duplicate").select("id", "k")
    assert kept.count() == 7 and G.duplicate_groups(kept, ["k"]).count() == 0
    assert rows(G.keep_first(df, ["k"])) == rows(kept)
