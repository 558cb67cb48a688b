"""Conversation repair against exhaustive search."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from shiftlens.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, position long, fault string"


def plain_damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv_id, turn)]
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(":".join(shown).encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv_id, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        if not body:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def best_repair(rows, faults):
    """Every edit of every row with up to two insertions at each place, the least (cost, audit)."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]
    for edits in itertools.product(*choices):
        for places in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, roles, lines = 0, "", "", []
            for k in range(len(rows) + 1):
                cost += 2 * len(places[k])
                audit += "I" * len(places[k])
                roles += places[k]
                lines += [R.ROLE_OF[c] + ":" for c in places[k]]
                if k == len(rows):
                    break
                _, role, text = rows[k]
                e = edits[k]
                cost += {"D": 3, "K": 0}.get(e, 2) + (faults[k] == "truncated" and e != "D")
                audit += e[0]
                if e != "D":
                    given = role if e == "K" else R.ROLE_OF[e[1]]
                    roles += given[:1] or "-"
                    lines.append(f"{given}:{text}")
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(lines))
    return best


def run(rows, patience=R.Repair.PATIENCE):
    faults = plain_faults(rows)
    job, edits = R.Repair(), []
    job.PATIENCE = job.limit = patience
    for (turn, role, text), fault in zip(rows, faults):
        edits += job.add(turn, role, text, fault)
    edits += job.finish()
    summary = R.Summary(0)
    for e in edits:
        summary.add(*e)
    lines = [f"{e[3]}:{e[4]}" for e in edits if e[0] != "D"]
    return summary, "\n".join(lines)


def random_rows(rng, n):
    roles = ["user", "assistant", "system", "tool", ""]
    return [(k, rng.choice(roles), rng.choice(["Hello.", "so", " ", "Yes!", "No?", "end"]) + rng.choice(["", f" {k}."])) for k in range(n)]


def test_cheapest_repair_by_exhaustive_search():
    rng = random.Random(3)
    for n in [0, 1, 1, 2, 2, 2] + [3] * 25:
        rows = random_rows(rng, n)
        cost, audit, text = best_repair(rows, plain_faults(rows))
        summary, repaired = run(rows)
        assert (summary.cost, "".join(summary.audit), repaired) == (cost, audit, text), rows


def test_streaming_changes_nothing():
    rng = random.Random(4)
    for n in (40, 300, 900):
        for kind in (random_rows(rng, n), [(k, "tool", f"{k}.") for k in range(n)], [(k, "user", f"{k}.") for k in range(n)]):
            whole, text = run(kind, patience=10**9)
            for patience in (1, 2, 7, 64):
                part, again = run(kind, patience)
                assert part.row() == whole.row() and again == text


def test_long_conversations_do_not_pile_up():
    job = R.Repair()
    most = 0
    for k in range(20_000):
        job.add(k, ["user", "assistant"][k % 2], f"{k}.", None)
        most = max(most, len(job.rows))
    assert most <= 2 * R.Repair.PATIENCE


def expected(rows):
    """conv_id -> the contract's row, with the parser of the operator."""
    out = {}
    for conv_id in {r[0] for r in rows}:
        mine = [r[1:] for r in plain_damage([r for r in rows if r[0] == conv_id])]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults = plain_faults(mine)
        summary, text = run(mine)
        turns = {t for t, _, _ in mine if t is not None}
        pairs = zip(mine, mine[1:])
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs),
            summary.cost,
            "".join(summary.audit),
            hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def test_query_rows(spark):
    rng = random.Random(5)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t + rng.choice([0, 0, 0, 5]), rng.choice(["user", "assistant", "user", "system"]), rng.choice(["Hi.", "Go on!", "x", f"Line {t}."])))
    # A row dropped by the damage alone in its conversation, nulls in every column, ties, long turns.
    alone = next(c for c in range(1000, 5000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(alone, 0, "user", "gone.")]
    rows += [(None, 0, "user", "Who?"), (None, 1, "assistant", "Me."), (70, None, "user", "A."), (70, None, None, None), (70, 3, None, "B.")]
    rows += [(71, 0, "user", "Same."), (71, 0, "user", "Same."), (71, 1, "assistant", "Same."), (71, 2, "user", "Same.")]
    rows += [(72, k, ["user", "assistant"][k % 2], "word " * 20_000 + f"{k}.") for k in range(4)] + [(73, 1, "", ""), (74, 2, "user", " ")]
    rows += [(80, k, ["user", "assistant"][(k // 3) % 2], f"Turn {k}.") for k in range(700)]
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    got = {r[0]: tuple(r[1:]) for r in R.summarize(R.repair(R.damaged(frame)), frame).collect()}
    assert got == expected(rows)
    assert got[alone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_edits_are_the_operators_output(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "assistant", "cut off"), (1, 3, "user", " ")]
    edits = R.repair(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)).orderBy("position").collect()
    assert "".join(e.edit for e in edits) == "KRKD"
    assert [(e.was, e.role, e.text, e.fault) for e in edits][1] == ("assistant", "user", "A.", None)
    assert [e.fault for e in edits] == [None, None, "truncated", "blank"] and [e.position for e in edits] == [0, 1, 2, 3]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.repair(none).count() == 0 and R.summarize(R.repair(none), none).count() == 0


@pytest.mark.parametrize("top", list(R.SHIFT))
def test_insertions_visit_no_top_twice(top):
    tops = [t for _, t in R.INSERTIONS[top]]
    assert len(tops) == len(set(tops)) and tops[0] == top
