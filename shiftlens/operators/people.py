"""Resolving names in feeds to people, clients, vehicles and projects.

Feeds repeat few names many times, so every operator here works on the *distinct* names of
a feed: a name that fills a third of all rows is one row here.  The resolved map is joined
back by the caller.  Lookups are equi joins on normalised keys; the fuzzy match joins on
the rare words of a name only, chosen so that no match above the threshold can be missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftlens.functions import names as NM
from shiftlens.functions.text import byte_length, match_key
from shiftlens.operators.common import union_all
from shiftlens.operators.containment import containments
from shiftlens.session import cut_lineage

FUZZY_THRESHOLD = 0.5


# ---------------------------------------------------------------- ids


def assign_ids(df: DataFrame, key: str, after: Column, id_column: str) -> DataFrame:
    """Dense new ids ``after + 1, after + 2, ..`` without a global sort.

    Rows are numbered inside 4,096 buckets of a digest of the key, and the buckets get
    offsets from their counts.  The digest spreads keys evenly and does not depend on how
    the data is partitioned, so a rerun assigns the same ids.
    """
    bucketed = df.withColumn("_b", F.substring(F.md5(key), 1, 3))
    sizes = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # at most 4,096 rows, so one task is enough for the running sum
    offsets = sizes.select(
        F.col("_b").alias("_ob"),
        (F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_o"),
    )
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    numbered = bucketed.withColumn("_r", inside).join(
        F.broadcast(offsets), F.col("_b") == F.col("_ob")
    )
    return numbered.select(
        (F.coalesce(after, F.lit(0)) + F.col("_o") + F.col("_r")).cast("bigint").alias(id_column), *df.columns
    )


def get_or_create(
    names: DataFrame, dimension: DataFrame, name: str, id_column: str, dim_name: str
) -> tuple[DataFrame, DataFrame]:
    """(map, new rows): every distinct filled name with its id, and the rows to add to the
    dimension for names it does not hold.  Names compare without case, accents and outer
    blanks; the smallest spelling of a new name is stored."""
    wanted = (
        names.where(F.trim(name) != "")
        .select(F.col(name).alias("_raw"), match_key(F.col(name)).alias("_key"))
        .distinct()
    )
    known = dimension.groupBy(match_key(F.col(dim_name)).alias("_dkey")).agg(
        F.min(id_column).alias("_did")
    )
    per_key = wanted.groupBy("_key").agg(F.min("_raw").alias("_spelling"))
    missing = per_key.join(known, F.col("_key") == F.col("_dkey"), "left_anti")
    highest = dimension.agg(F.max(id_column)).scalar()
    created = assign_ids(missing, "_key", highest, id_column)
    both = known.select("_dkey", "_did", F.lit(False).alias("created")).unionByName(
        created.select(F.col("_key").alias("_dkey"), F.col(id_column).alias("_did"), F.lit(True).alias("created"))
    )
    resolved = wanted.join(both, F.col("_key") == F.col("_dkey")).select(
        F.col("_raw").alias(name), F.col("_did").alias(id_column), "created"
    )
    return resolved, created.select(id_column, F.col("_spelling").alias(dim_name))


def new_projects(codes: DataFrame, projects: DataFrame, code: str = "project_code") -> DataFrame:
    """Rows for project codes that do not exist yet; the name is made from the code."""
    _, created = get_or_create(codes, projects, code, "project_id", "code")
    return created.select(
        "project_id",
        "code",
        F.concat(F.lit("Progetto "), "code").alias("name"),
        F.lit("active").alias("state"),
    )


# ---------------------------------------------------------------- exact lookups


def lookup_by_parts(names: DataFrame, people: DataFrame, name: str = "name") -> DataFrame:
    """Exact lookup of stored people: the name read as ``First Rest``, then as
    ``Surname, First``."""
    stored = people.groupBy(
        match_key(F.col("first_name")).alias("_f"), match_key(F.col("last_name")).alias("_l")
    ).agg(F.min("employee_id").alias("_id"))
    first, rest = NM.first_and_rest(F.col(name))
    given, family = NM.surname_first(F.col(name))
    keyed = (
        names.select(name)
        .distinct()
        .select(
            name,
            F.when(F.trim(F.col(name)).contains(" "), match_key(first)).alias("_f1"),
            match_key(rest).alias("_l1"),
            match_key(given).alias("_f2"),
            match_key(family).alias("_l2"),
        )
    )
    one = stored.select(F.col("_f").alias("_a"), F.col("_l").alias("_b"), F.col("_id").alias("_id1"))
    two = stored.select(F.col("_f").alias("_c"), F.col("_l").alias("_d"), F.col("_id").alias("_id2"))
    return (
        keyed.join(one, (F.col("_f1") == F.col("_a")) & (F.col("_l1") == F.col("_b")), "left")
        .join(two, (F.col("_f2") == F.col("_c")) & (F.col("_l2") == F.col("_d")), "left")
        .select(name, F.coalesce("_id1", "_id2").alias("employee_id"))
    )


def full_name_key(people: DataFrame) -> Column:
    return match_key(F.concat_ws(" ", people["first_name"], people["last_name"]))


def lookup_full_name(names: DataFrame, people: DataFrame, name: str = "name") -> DataFrame:
    """Case-insensitive lookup on the full name of the master list."""
    stored = people.groupBy(full_name_key(people).alias("_k")).agg(F.min("employee_id").alias("employee_id"))
    return (
        names.select(name)
        .distinct()
        .join(stored, match_key(F.col(name)) == F.col("_k"), "left")
        .select(name, "employee_id")
    )


def generate_aliases(
    people: DataFrame, given_variants: dict[str, str] | None = None, surname_letters: int = 4
) -> DataFrame:
    """Alias rows: given-name variants with the surname or its first letters, without the
    original pair.  An alias that several people share belongs to the lowest id."""
    first, last = F.col("first_name"), F.col("last_name")
    pairs = [F.lit(x) for kv in (given_variants or {}).items() for x in kv]
    variant = F.try_element_at(F.create_map(*pairs), first) if pairs else F.lit(None).cast("string")
    short = F.when(byte_length(last) > surname_letters, F.substring(last, 1, surname_letters))
    firsts = F.array_compact(F.array(first, variant))
    lasts = F.array_compact(F.array(last, short))
    rows = (
        people.select("employee_id", first, last, F.explode(firsts).alias("alias_first"), lasts.alias("_l"))
        .select("*", F.explode("_l").alias("alias_last"))
        .where((F.col("alias_first") != first) | (F.col("alias_last") != last))
    )
    return rows.groupBy("alias_first", "alias_last").agg(F.min("employee_id").alias("employee_id"))


def lookup_alias(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Lookup in the alias table."""
    stored = aliases.groupBy(
        match_key(F.concat_ws(" ", "alias_first", "alias_last")).alias("_k")
    ).agg(F.min("employee_id").alias("employee_id"))
    return (
        names.select(name)
        .distinct()
        .join(stored, match_key(F.col(name)) == F.col("_k"), "left")
        .select(name, "employee_id")
    )


# ---------------------------------------------------------------- fuzzy lookup


def tokens(text: Column, shortest: int = 1) -> Column:
    """Distinct words of at least ``shortest`` characters."""
    words = F.split(match_key(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= shortest))


def fuzzy_match(
    names: DataFrame,
    targets: DataFrame,
    name: str,
    target_id: str,
    target_name: Column,
    threshold: float = FUZZY_THRESHOLD,
    shortest: int = 1,
) -> DataFrame:
    """Best target per distinct name by the weight of shared words; only above the threshold.

    Score: weight of the shared words over the weight of all words of the name, where a
    word weighs ln(1 + targets / targets that hold it).  Ties go to the lowest id.

    Words are sorted from heavy to light.  A target that shares only words from a position
    on whose weights do not exceed the threshold cannot qualify, so only the words before
    that position are looked up.  That skips the common words and misses nothing.
    """
    indexed = targets.select(F.col(target_id).alias("_t"), tokens(target_name, shortest).alias("_tt"))
    postings = indexed.select("_t", "_tt", F.explode("_tt").alias("_w"))
    total = targets.agg(F.count(F.lit(1))).scalar()
    seen = postings.groupBy(F.col("_w").alias("_fw")).agg(F.count(F.lit(1)).alias("_df"))
    words = (
        names.select(name)
        .distinct()
        .select(name, F.explode(tokens(F.col(name), shortest)).alias("_q"))
        .join(seen, F.col("_q") == F.col("_fw"), "left")
    )
    idf = F.log(F.lit(1.0) + total.cast("double") / F.coalesce("_df", F.lit(1)).cast("double"))
    weight = F.floor(idf * F.lit(1e6) + F.lit(0.5)).cast("bigint")
    per_name = words.select(name, "_q", weight.alias("_wt")).groupBy(name).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("_wt")).alias("neg"), F.col("_q").alias("word")))).alias("_ws")
    )  # a name has a bounded number of words
    sums = per_name.withColumn("_total", F.expr("aggregate(_ws, 0L, (a, x) -> a - x.neg)")).withColumn(
        "_probe",
        F.expr(
            "filter(transform(_ws, (x, i) -> named_struct('word', x.word, 'rest', "
            "aggregate(slice(_ws, i + 1, size(_ws)), 0L, (a, y) -> a - y.neg))), "
            f"p -> p.rest > {threshold}D * _total)"
        ),
    )
    probes = sums.select(name, "_ws", "_total", F.explode("_probe.word").alias("_p"))
    hits = probes.join(postings, F.col("_p") == F.col("_w"))
    shared = F.expr(
        "aggregate(filter(_ws, x -> array_contains(_tt, x.word)), 0L, (a, x) -> a - x.neg)"
    )
    scored = hits.select(name, "_t", "_total", shared.alias("_s")).where(
        F.col("_s") > F.lit(threshold) * F.col("_total")
    )
    best = scored.groupBy(name).agg(
        F.max(F.struct(F.col("_s").alias("s"), (-F.col("_t")).alias("neg"), F.col("_total").alias("total"))).alias("_b")
    )
    return best.select(
        name,
        (-F.col("_b.neg")).alias(target_id),
        (F.col("_b.s").cast("double") / F.col("_b.total").cast("double")).alias("score"),
    )


# ---------------------------------------------------------------- whole resolution


def valid_people_names(names: DataFrame, vehicles: DataFrame, name: str = "name") -> DataFrame:
    """Distinct names that may become a person: the name rules, and not a vehicle's name."""
    cars = vehicles.select(match_key(F.col("vehicle_name")).alias("_v")).distinct()
    return (
        names.select(name)
        .distinct()
        .where(NM.is_valid_person_name(F.col(name)))
        .join(cars, match_key(F.col(name)) == F.col("_v"), "left_anti")
    )


def resolve_people(
    names: DataFrame,
    masters: DataFrame,
    aliases: DataFrame,
    people: DataFrame,
    vehicles: DataFrame,
    name: str = "name",
) -> DataFrame:
    """What each distinct name stands for.

    A field with several people is split; its parts, then the whole field, are candidates
    in that order.  A candidate is looked up in the master list, the aliases, by fuzzy
    match and among stored people; one that is found nowhere but is a valid name stands for
    a new person.  The first candidate with an answer wins.

    Columns: the name, ``candidate``, ``method`` (master, alias, fuzzy, stored, new or
    rejected) and ``employee_id`` (NULL for new and rejected).
    """
    distinct = names.select(name).where(F.trim(name) != "").distinct()
    parts = NM.split_people(F.trim(name))
    listed = F.when(F.size(parts) > 1, F.concat(parts, F.array(F.trim(name)))).otherwise(parts)
    expanded = distinct.select(name, F.posexplode(listed).alias("pos", "candidate"))
    c = expanded.select("candidate").distinct()

    def tagged(found: DataFrame, rank: int, method: str) -> DataFrame:
        return found.where("employee_id is not null").select(
            "candidate",
            F.struct(
                F.lit(rank).alias("rank"), F.lit(method).alias("method"), F.col("employee_id").cast("bigint").alias("employee_id")
            ).alias("a"),
        )

    active = masters.where("active")
    fuzzy = fuzzy_match(
        c, active, "candidate", "employee_id", F.concat_ws(" ", "first_name", "last_name")
    )
    fresh = valid_people_names(c, vehicles, "candidate").withColumn("employee_id", F.lit(-1))
    answers = union_all(
        [
            tagged(lookup_full_name(c, masters, "candidate"), 1, "master"),
            tagged(lookup_alias(c, aliases, "candidate"), 2, "alias"),
            tagged(fuzzy, 3, "fuzzy"),
            tagged(lookup_by_parts(c, people, "candidate"), 4, "stored"),
            tagged(fresh, 5, "new"),
        ]
    )
    best = answers.groupBy(F.col("candidate").alias("_c")).agg(F.min("a").alias("a"))
    chosen = (
        expanded.join(best, F.col("candidate") == F.col("_c"), "left")
        .groupBy(name)
        .agg(F.min(F.when(F.col("a").isNotNull(), F.struct("pos", "candidate", "a"))).alias("r"))
    )
    return chosen.select(
        name,
        F.col("r.candidate").alias("candidate"),
        F.coalesce("r.a.method", F.lit("rejected")).alias("method"),
        F.when(F.col("r.a.employee_id") >= 0, F.col("r.a.employee_id")).alias("employee_id"),
    )


def resolve_fixed_list(
    names: DataFrame, masters: DataFrame, name: str = "name"
) -> DataFrame:
    """Resolution against a closed master list: the whole field first, then the first part
    that is on the list; nobody is created."""
    distinct = names.select(name).where(F.trim(name) != "").distinct()
    parts = NM.split_people(F.trim(name))
    listed = F.when(F.size(parts) > 1, F.concat(F.array(F.trim(name)), parts)).otherwise(F.array(F.trim(name)))
    expanded = distinct.select(name, F.posexplode(listed).alias("pos", "candidate"))
    found = lookup_full_name(expanded, masters, "candidate").where("employee_id is not null")
    best = (
        expanded.join(found, "candidate")
        .groupBy(name)
        .agg(F.min(F.struct("pos", "employee_id")).alias("r"))
        .select(name, F.col("r.employee_id").alias("employee_id"))
    )
    return distinct.join(best, name, "left")


def link_or_create(
    resolved: DataFrame, masters: DataFrame, people: DataFrame, name: str = "name"
) -> tuple[DataFrame, DataFrame]:
    """(people to create, aliases to record) for names resolved to master ids.

    A master without a linked person gets one; each spelling of it that differs from the
    master's name becomes an alias.
    """
    hits = resolved.where("employee_id is not null").select(name, F.col("employee_id").alias("master_id"))
    linked = people.where("master_id is not null").select("master_id").distinct()
    fresh = hits.join(linked, "master_id", "left_anti")
    wanted = fresh.select("master_id").distinct()
    m = masters.select(F.col("employee_id").alias("master_id"), "first_name", "last_name")
    created = wanted.join(m, "master_id")
    first, rest = NM.first_and_rest(F.col(name))
    spelled = F.lower(F.concat_ws(" ", "first_name", "last_name")) != F.lower(F.col(name))
    aliases = (
        fresh.join(m, "master_id")
        .where(spelled)
        .groupBy(first.alias("alias_first"), rest.alias("alias_last"))
        .agg(F.min("master_id").alias("master_id"))
    )
    return created, aliases


# ---------------------------------------------------------------- master data


def bulk_link(
    rows: DataFrame, masters: DataFrame, keys: list[str], link: str = "master_id", master_id: str = "employee_id"
) -> DataFrame:
    """Fill a missing master id from the master row with equal names."""
    stored = masters.groupBy(*[match_key(F.col(k)).alias(f"_m_{k}") for k in keys]).agg(
        F.min(master_id).alias("_m")
    )
    on = [match_key(F.col(k)) == F.col(f"_m_{k}") for k in keys]
    return rows.join(stored, on, "left").select(
        *[F.coalesce(link, "_m").alias(link) if c == link else F.col(c) for c in rows.columns]
    )


def name_variants(people: DataFrame, masters: DataFrame) -> DataFrame:
    """Stored people linked to a master whose name differs: their spellings as aliases."""
    m = masters.select(
        F.col("employee_id").alias("master_id"), F.col("first_name").alias("_mf"), F.col("last_name").alias("_ml")
    )
    differs = (F.col("first_name") != F.col("_mf")) | (F.col("last_name") != F.col("_ml"))
    return (
        people.join(m, "master_id")
        .where(differs)
        .select("master_id", F.col("first_name").alias("alias_first"), F.col("last_name").alias("alias_last"))
        .distinct()
    )


def unified(
    rows: DataFrame, masters: DataFrame, columns: list[str], link: str = "master_id", master_id: str = "employee_id"
) -> DataFrame:
    """The master's value where there is one, the row's own value otherwise."""
    m = masters.select(
        F.col(master_id).alias("_m"), *[F.col(c).alias(f"_m_{c}") for c in columns]
    )
    return rows.join(m, F.col(link) == F.col("_m"), "left").select(
        *[F.coalesce(f"_m_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns]
    )


def consolidate(
    sources: list[tuple[str, DataFrame]], keys: list[str], row_id: str = "id"
) -> DataFrame:
    """One row per key over several tables, the first table winning, then the lowest id.
    Columns a table lacks become NULL; the origin table and id are recorded."""
    tagged = [
        df.withColumnRenamed(row_id, "origin_id").withColumns(
            {"origin": F.lit(label), "_rank": F.lit(rank)}
        )
        for rank, (label, df) in enumerate(sources)
    ]
    rows = union_all(tagged, fill=True)
    order = ["_rank", "origin_id"]
    packed = F.struct(*order, *[c for c in rows.columns if c not in order])
    first = rows.groupBy(*[match_key(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.min(packed).alias("_r")
    )
    return first.select("_r.*").drop("_rank")


def review_queue(
    names: DataFrame,
    clients: DataFrame,
    pending: DataFrame,
    source: str,
    name: str = "client_name",
) -> DataFrame:
    """Client names that match no client, once each, with the best suggestion and a
    confidence of 0.7 with and 0.0 without one.  Names already pending are left out."""
    known = clients.select(match_key(F.col("client_name")).alias("_k")).distinct()
    waiting = pending.where("status = 'pending'").select(match_key(F.col("client_name")).alias("_k")).distinct()
    unmatched = (
        names.where(F.trim(name) != "")
        .groupBy(match_key(F.col(name)).alias("_key"))
        .agg(F.min(F.trim(name)).alias("client_name"))
        .join(known, F.col("_key") == F.col("_k"), "left_anti")
        .join(waiting, F.col("_key") == F.col("_k"), "left_anti")
        .select("client_name")
    )
    suggestions = fuzzy_match(
        unmatched, clients.select("client_id", F.col("client_name").alias("_target")), "client_name", "client_id", F.col("_target")
    )
    return unmatched.join(suggestions, "client_name", "left").select(
        "client_name",
        F.lit(source).alias("source_type"),
        F.col("client_id").alias("suggested_id"),
        F.when(F.col("client_id").isNotNull(), F.lit(0.7)).otherwise(F.lit(0.0)).alias("confidence"),
        F.lit("pending").alias("status"),
    )


def pending_queue(queue: DataFrame, clients: DataFrame) -> DataFrame:
    """The pending queue with the names of the suggested and the assigned client, surest
    first, then oldest."""
    suggested = clients.select(F.col("client_id").alias("suggested_id"), F.col("client_name").alias("suggested_name"))
    assigned = clients.select(F.col("client_id").alias("assigned_id"), F.col("client_name").alias("assigned_name"))
    return (
        queue.where("status = 'pending'")
        .join(suggested, "suggested_id", "left")
        .join(assigned, "assigned_id", "left")
        .orderBy(F.desc("confidence"), "created_at", "client_name")
    )


def expected_members(expected: DataFrame, people: DataFrame) -> DataFrame:
    """Which expected names exist, and how many stored people have a name part that contains
    the expected given name or surname.

    Containment is looked up piece by piece (see ``containment``), name part by name part.  People
    found by either name are those found by the one, and by the other, less those found by both;
    the latter come from the few expected names that a person's own parts contain, so no expected
    name is ever joined with everybody who has its given name.
    """
    first, last = match_key(F.col("first_name")), match_key(F.col("last_name"))
    e = expected.select("first_name", "last_name").distinct().withColumns({"_ef": first, "_el": last})
    stored = people.select("employee_id", first.alias("_sf"), last.alias("_sl"))
    exact = stored.groupBy("_sf", "_sl").agg(F.min("employee_id").alias("employee_id"))
    names = e.select("_ef", "_el").where("_ef is not null and _el is not null").distinct()
    # Which of the two a pattern is: a person's given names only meet a person's surnames below.
    roles = (
        names.select(F.expr("inline(array(named_struct('_q', _ef, 'role', 1), named_struct('_q', _el, 'role', 2)))"))
        .where("_q <> ''")
        .groupBy("_q")
        .agg(F.bit_or("role").alias("role"))
    )
    parts = stored.select("employee_id", F.explode(F.array_distinct(F.array("_sf", "_sl"))).alias("text")).distinct()
    found = containments(roles.select(F.col("_q").alias("pattern")), parts)
    pieces = cut_lineage(found.join(parts, "text").select(F.col("pattern").alias("_q"), "employee_id").distinct())
    alone = pieces.groupBy("_q").agg(F.count(F.lit(1)).alias("n"))
    mine = pieces.join(roles, "_q")
    givens = mine.where("role & 1 = 1").select(F.col("_q").alias("_ef"), F.col("employee_id").alias("_id"))
    both = (
        givens.join(mine.where("role & 2 = 2"), F.col("_id").eqNullSafe(F.col("employee_id")))
        .select("_ef", F.col("_q").alias("_el"))
        .groupBy("_ef", "_el")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # A name whose two parts are the same counts once: all it finds is found by both.
    variants = (
        names.join(alone.select(F.col("_q").alias("_ef"), F.col("n").alias("by_first")), "_ef", "left")
        .join(alone.select(F.col("_q").alias("_el"), F.col("n").alias("by_last")), "_el", "left")
        .join(both, ["_ef", "_el"], "left")
        .select("_ef", "_el", F.expr("coalesce(by_first, 0) + coalesce(by_last, 0) - coalesce(n, 0)").alias("variants"))
    )
    return (
        e.join(exact, (F.col("_ef") == F.col("_sf")) & (F.col("_el") == F.col("_sl")), "left")
        .join(variants, ["_ef", "_el"], "left")
        .select(
            "first_name",
            "last_name",
            F.col("employee_id").isNotNull().alias("present"),
            "employee_id",
            F.coalesce("variants", F.lit(0)).alias("variants"),
        )
    )
