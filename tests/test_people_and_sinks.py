"""Name resolution, ids, upserts on disk, logs and configuration backups."""

import math

import pytest

from conftest import day, rows, ts
from shiftlens.operators import people as P, quality as Q
from shiftlens.sinks import json_output as J, upsert as U
from shiftlens.sources import logs as L
from shiftlens import settings as ST

PEOPLE = "employee_id long, first_name string, last_name string, active boolean"


def people(spark):
    return spark.createDataFrame(
        [(1, "Anna", "Verdi", True), (2, "Luca", "Verdi", True), (3, "Marco", "De Santis", True), (4, "Anna", "Gialli", False)],
        PEOPLE,
    )


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def brute_fuzzy(query, targets, threshold=0.5):
    words = {i: set(n.lower().split()) for i, n in targets.items()}

    def weight(w):
        df = sum(w in ws for ws in words.values())
        return math.floor(math.log(1 + len(targets) / max(df, 1)) * 1e6 + 0.5)

    q = {w for w in query.lower().split() if len(w) >= 3}
    total = sum(map(weight, q))
    scored = [(-sum(weight(w) for w in q & ws), i) for i, ws in words.items()]
    best = min((x for x in scored if -x[0] > threshold * total), default=None)
    return best and best[1]


def test_fuzzy_prefix_misses_nothing(spark):
    first = ["anna", "luca", "marco", "carla", "dino"]
    last = ["verdi", "rossi", "bianchi", "santis", "gallo", "ferri", "lodi"]
    targets = {i: f"{first[i % 5]} {last[i % 7]} {'senior' if i % 3 else 'junior'}" for i in range(35)}
    df = spark.createDataFrame(list(targets.items()), "id long, target string")
    queries = [f"{f} {x}" for f in first for x in last] + ["senior", "anna", "verdi junior zzz", "nobody here", "gallo senior anna dino"]
    got = {r.name: r.id for r in P.fuzzy_match(names(spark, *queries), df, "name", "id", df["target"]).collect()}
    assert got == {q: b for q in queries if (b := brute_fuzzy(q, targets)) is not None}


def test_resolution_order(spark):
    aliases = spark.createDataFrame([("Annina", "Verd", 1)], "alias_first string, alias_last string, employee_id long")
    stored = spark.createDataFrame([(50, "Remo", "Lodi", True)], PEOPLE)
    cars = spark.createDataFrame([(1, "Panda")], "vehicle_id long, vehicle_name string")
    raw = names(spark, "ANNA VERDI", "annina verd", "De Santis", "Lodi, Remo", "Info/Luca Verdi", "Panda", "Nuova Persona", "x@y.it", " ")
    got = {r.name: (r.method, r.employee_id) for r in P.resolve_people(raw, people(spark), aliases, stored, cars).collect()}
    assert got == {
        "ANNA VERDI": ("master", 1), "annina verd": ("alias", 1), "De Santis": ("fuzzy", 3),
        "Lodi, Remo": ("new", None), "Info/Luca Verdi": ("master", 2), "Panda": ("rejected", None),
        "Nuova Persona": ("new", None), "x@y.it": ("rejected", None),
    }
    by_parts = {r.name: r.employee_id for r in P.lookup_by_parts(raw, stored).collect()}
    assert by_parts["Lodi, Remo"] == 50


def test_ids_are_dense_and_stable(spark):
    dim = spark.createDataFrame([(10, "A"), (11, "é")], "id long, label string")
    raw = spark.range(500).selectExpr("concat('N', id % 250) as label").union(names(spark, "a ", "E", " "))
    mapped, created = P.get_or_create(raw, dim, "label", "id", "label")
    ids = sorted(r.id for r in created.collect())
    assert ids == list(range(12, 262))
    assert rows(mapped.where("not created")) == [("E", 11, False), ("a ", 10, False)]
    again = P.get_or_create(raw.repartition(7), dim, "label", "id", "label")[1]
    assert rows(again) == rows(created)


def test_upsert_table_replaces_only_touched_days(spark, tmp_path):
    path, staging = str(tmp_path / "t"), str(tmp_path / "s")
    schema = "employee_id long, work_date date, hours int, note string"
    first = spark.createDataFrame([(1, day("2025-06-01"), 1, "a"), (1, day("2025-06-02"), 2, "b")], schema)
    second = spark.createDataFrame([(1, day("2025-06-02"), 5, "c"), (2, day("2025-06-02"), 6, "d")], schema)
    keys = ["employee_id", "work_date"]
    U.upsert_table(first, path, staging, keys, "work_date")
    untouched = sorted(p.name for p in (tmp_path / "t" / "work_date=2025-06-01").iterdir())
    for _ in range(2):
        U.upsert_table(second, path, staging, keys, "work_date", refresh=["hours"])
    got = rows(spark.read.parquet(path).select("employee_id", "work_date", "hours", "note"))
    assert got == [(1, day("2025-06-01"), 1, "a"), (1, day("2025-06-02"), 5, "b"), (2, day("2025-06-02"), 6, "d")]
    assert untouched == sorted(p.name for p in (tmp_path / "t" / "work_date=2025-06-01").iterdir())
    U.rebuild_table(second, path, "work_date")
    assert spark.read.parquet(path).count() == 2


def test_upsert_reads_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "employee_id long, work_date date, hours int"
    days = [day(f"2025-06-{k:02d}") for k in range(1, 21)]
    table = spark.createDataFrame([(1, d, 1) for d in days], schema)
    U.rebuild_table(table, path, "work_date")
    updates = spark.createDataFrame([(1, days[3], 2), (2, days[3], 2), (1, days[5], 2)], schema)
    pruned = U.in_partitions(spark.read.parquet(path), updates, "work_date")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "2025-06-04" in filters and "2025-06-06" in filters and len(pruned.inputFiles()) == 20
    assert rows(pruned) == rows(U.in_partitions(spark.read.parquet(path), updates, "work_date", most=1))
    assert pruned.count() == 2
    with pytest.raises(ValueError, match="more than once"):
        U.upsert_table(updates.union(updates), str(tmp_path / "new"), str(tmp_path / "s"), ["employee_id", "work_date"], "work_date")


def test_resolution_columns_survive(spark):
    d = day("2025-06-01")
    stored = spark.createDataFrame(
        [(1, d, "overlaps", "low", "old", None, 1, True, "seen", 9, ts("2025-06-02 10:00"))],
        "employee_id long, work_date date, type string, severity string, description string, details string, findings long, "
        "resolved boolean, note string, resolved_by long, resolved_at timestamp",
    )
    found = spark.createDataFrame(
        [(1, d, "overlaps", "high", "new", "{}"), (1, d, "overlaps", "critical", "worse", "{}"), (2, d, "overlaps", "high", "n", "{}")],
        "employee_id long, work_date date, type string, severity string, description string, details string",
    )
    out = U.upsert_anomalies(stored, found)
    assert rows(out.select("employee_id", "severity", "description", "details", "findings", "resolved", "note")) == [
        (1, "critical", "worse; new", "{}; {}", 2, True, "seen"),
        (2, "high", "n", "{}", 1, False, None),
    ]
    assert rows(U.upsert_anomalies(out, found)) == rows(out)


def test_config_backup_and_restore(spark, tmp_path):
    config = ST.default_config(spark)
    J.backup_config(config, str(tmp_path / "backup"))
    changed = J.set_config(config, config.where("key = 'alert_ore_minime'").replace("7", "5", subset=["value"]))
    assert ST.Settings.from_config(changed).min_hours == 5
    assert rows(J.restore_config(spark, str(tmp_path / "backup"), changed)) == rows(config)


def test_logs(spark, tmp_path):
    lines = [
        "[2025-07-03 21:23:11] [s1] [INFO] [Memory: 1.01MB] [Time: 0s] === Avvio sessione import (ID: s1) ===",
        '[2025-07-03 21:23:12] [s1] [ERROR] [Memory: 1.5MB] [Time: 0.333s] broken | Context: {"a":1}',
        "[2025-07-03 21:23:13] [s1] [WARNING] [Memory: 1.5MB] [Time: 0.5s] careful",
    ]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    df = L.read_log_lines(spark, str(tmp_path))
    assert L.log_stats(df).first()[1:] == (3, 1, 1, 1, 0, 1)
    last = L.recent_lines(df, 2).collect()
    assert [r.level for r in last] == ["WARNING", "ERROR"] and last[1].elapsed_s == 0.333


def test_orphans_with_null_parent(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long")
    parent = spark.createDataFrame([(1,)], "p long")
    with_null = parent.union(spark.createDataFrame([(None,)], "p long"))
    assert Q.orphan_count(child, parent, "k", "p", "x").first().orphans == 2
    assert Q.orphans_not_in(child, with_null, "k", "p", "x").first().orphans == 0
    assert Q.orphans_not_in(child, parent, "k", "p", "x").first().orphans == 2


def test_expected_members(spark):
    expected = spark.createDataFrame([("Anna", "Verdi"), ("Piero", "Bo"), ("Mar", "Zz")], "first_name string, last_name string")
    got = {(r.first_name, r.present, r.variants) for r in P.expected_members(expected, people(spark)).collect()}
    assert got == {("Anna", True, 3), ("Piero", False, 0), ("Mar", False, 1)}


def test_containment_of_long_names_by_rarest_gram(spark):
    import random

    from shiftlens.operators.containment import containments

    rng = random.Random(31)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(5000)) for _ in range(20)] + ["", None, "è", "aèèb"]
    patterns = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    patterns += [texts[300][4000:4040], texts[301], "zz", "abz", "è", "èè", "", None]
    got = containments(
        spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame([(t,) for t in texts], "text string")
    )
    want = {(p, t) for p in patterns for t in texts if p and t and p in t}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_expected_members_with_long_names(spark):
    stored = people(spark).union(spark.createDataFrame([(9, "x" * 5000 + "anna", "Y" * 5000, True)], PEOPLE))
    expected = spark.createDataFrame([("Anna", "Verdi"), ("Nobody", "Q")], "first_name string, last_name string")
    got = {r.first_name: tuple(r) for r in P.expected_members(expected, stored).collect()}
    assert got == {"Anna": ("Anna", "Verdi", True, 1, 4), "Nobody": ("Nobody", "Q", False, None, 0)}


def rows_of_joins(df):
    """Rows that the joins of an executed plan put out, by plan node."""
    found = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        inner = [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
        for child in inner:
            walk(child)

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_expected_members_with_one_given_name_for_all(spark):
    """Many expected names share a given name that many stored people have: the variants are counted
    without joining the ones with the others."""
    letters = "abcdefghij"
    word = lambda i: "zz" + "".join(letters[int(c)] for c in str(i))
    stored = [(i, "Anna" if i % 2 else "Annalisa", word(i), True) for i in range(3000)]
    stored += [(None, "Anna", "Zzb", True), (None, "anna", "zzb", True), (5, "Bo", word(7), True), (9000, None, "annazzb", True), (9001, "", "", True)]
    expected = [("Anna", word(i)) for i in range(3000)] + [("Zzb", "zzb"), ("", "zzbc"), (None, "zzb"), ("Anna", ""), ("anna", "zzb")]
    got = P.expected_members(spark.createDataFrame(expected, "first_name string, last_name string"), spark.createDataFrame(stored, PEOPLE))
    found = {(r.first_name, r.last_name): (r.present, r.variants) for r in got.collect()}
    assert len(found) == len(set(expected))
    fold = lambda t: (t or "").lower()
    for f, l in [x for k, x in enumerate(expected) if k % 97 == 0 or k >= 3000 or k < 12]:
        want = len({i for i, sf, sl, _ in stored if any(q and q in fold(t) for q in (fold(f), fold(l)) for t in (sf, sl))})
        present = any(sf is not None and (fold(sf), fold(sl)) == (fold(f), fold(l)) and i is not None for i, sf, sl, _ in stored)
        assert found[f, l] == ((present, want) if f is not None else (False, 0)), (f, l)
    assert max(rows_of_joins(got)) < 40_000  # 3,000 names with 3,000 people would be 9 million


def test_containment_rows_grow_with_the_texts(spark):
    """Texts that share grams with patterns they do not hold."""
    from shiftlens.operators.containment import containments

    numbers = spark.range(4000).selectExpr("translate(lpad(cast(id as string), 4, '0'), '0123456789', 'abcdefghij') as w")
    texts, patterns = numbers.selectExpr("concat('xy', w, 'zzz') as text"), numbers.selectExpr("concat('y', reverse(w)) as pattern")
    got = containments(patterns, texts)
    assert len(got.collect()) == 1600  # those whose reverse is a number below 4,000 too
    assert max(rows_of_joins(got)) < 60_000  # the rarest gram of a pattern is in up to 40 texts
