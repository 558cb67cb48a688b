"""Data-quality checks and inventories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.functions import names as NM
from shiftlens.operators.common import count_where, union_all


# ---------------------------------------------------------------- names


def name_issues(people: DataFrame, row_id: str = "employee_id") -> DataFrame:
    """Stored people whose name has an issue, with its class."""
    issue = NM.name_issue(F.col("first_name"), F.col("last_name"))
    return people.select(row_id, "first_name", "last_name", issue.alias("issue")).where("issue <> 'VALIDO'")


def name_patterns(people: DataFrame) -> DataFrame:
    """How many stored people show each name pattern."""
    return people.groupBy(
        NM.name_pattern(F.col("first_name"), F.col("last_name")).alias("pattern")
    ).agg(F.count(F.lit(1)).alias("people"))


def separated_names(people: DataFrame, row_id: str = "employee_id") -> DataFrame:
    """Stored names that hold a separator, one row per separator, with the proposed split."""
    first, last = F.col("first_name"), F.col("last_name")
    found = people.select(row_id, first, last, F.explode(NM.stored_separators(first, last)).alias("separator"))

    def pieces(column: Column, label: str) -> Column:
        parts = F.expr(f"replace({label}, separator, '] [')")
        title = "first" if label == "first_name" else "last"
        return F.when(
            F.contains(column, F.col("separator")), F.concat(F.lit(f"{title}: ["), parts, F.lit("]"))
        )

    return found.withColumn(
        "split", F.concat_ws(" ", pieces(first, "first_name"), pieces(last, "last_name"))
    )


def reserved_names(people: DataFrame, words: list[str], row_id: str = "employee_id") -> DataFrame:
    """Vehicle or system words stored as people."""
    low = [w.lower() for w in words]
    hit = F.lower(F.trim("first_name")).isin(low) | F.lower(F.trim("last_name")).isin(low)
    return people.where(hit).select(row_id, "first_name", "last_name")


# ---------------------------------------------------------------- row rules


def activity_rejects(activities: DataFrame) -> Column:
    """Broken row rule of an activity, NULL when sound."""
    return F.when(F.col("end_ts") < F.col("start_ts"), "end_before_start").when(
        F.col("duration_hours") <= 0, "duration_not_positive"
    )


def timesheet_rejects(timesheets: DataFrame) -> Column:
    return F.when(F.col("end_ts") < F.col("start_ts"), "end_before_start").when(
        F.col("hours") <= 0, "hours_not_positive"
    )


def split_valid(df: DataFrame, broken: Column) -> tuple[DataFrame, DataFrame]:
    """(sound rows, rejected rows with the rule they break)."""
    tagged = df.withColumn("broken_rule", broken)
    return tagged.where("broken_rule is null").drop("broken_rule"), tagged.where("broken_rule is not null")


# ---------------------------------------------------------------- references


def orphan_count(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, check: str) -> DataFrame:
    """Child rows whose filled key has no parent.

    Child rows shrink to one row per key before they meet the parent table.
    """
    keys = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_k")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    parents = parent.select(F.col(parent_key).alias("_p"))
    return keys.join(parents, F.col("_k") == F.col("_p"), "left_anti").agg(
        F.lit(check).alias("check_name"), F.coalesce(F.sum("_n"), F.lit(0)).alias("orphans")
    )


def orphans_not_in(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, check: str) -> DataFrame:
    """The same under ``NOT IN``: with a NULL among the parents no row qualifies at all."""
    has_null = parent.where(F.col(parent_key).isNull()).agg(F.count(F.lit(1)) > 0).scalar()
    counted = orphan_count(child, parent, child_key, parent_key, check)
    return counted.select("check_name", F.when(has_null, F.lit(0)).otherwise(F.col("orphans")).alias("orphans"))


def per_parent_counts(parents: DataFrame, children: dict[str, DataFrame], key: str = "employee_id") -> DataFrame:
    """Rows each parent has in each child table, zero included.

    All child tables are reduced in one aggregation over their union.
    """
    rows = union_all([df.select(key, F.lit(name).alias("_t")) for name, df in children.items()])
    counts = rows.groupBy(key).agg(*[count_where(F.col("_t") == name).alias(name) for name in children])
    joined = parents.select(key).join(counts, key, "left")
    return joined.select(key, *[F.coalesce(name, F.lit(0)).alias(name) for name in children])


def reference_counts(parents: DataFrame, children: dict[str, DataFrame], key: str = "employee_id") -> DataFrame:
    """(table, parent, rows) for every parent that is referred to."""
    rows = union_all([df.select(F.lit(name).alias("table_name"), key) for name, df in children.items()])
    counts = rows.where(F.col(key).isNotNull()).groupBy("table_name", key).agg(F.count(F.lit(1)).alias("reference_count"))
    return counts.join(parents.select(key), key, "left_semi")


def dependency_counts(
    removed: DataFrame, children: dict[str, DataFrame], anomalies: DataFrame, key: str = "employee_id"
) -> DataFrame:
    """Rows per table that depend on people about to be removed; an anomaly depends on its
    employee or on who resolved it, and counts once."""
    ids = removed.select(F.col(key).alias("_id")).distinct()
    rows = union_all([df.select(F.lit(name).alias("table_name"), F.col(key).alias("_k")) for name, df in children.items()])
    per_key = rows.groupBy("table_name", "_k").agg(F.count(F.lit(1)).alias("n"))
    plain = per_key.join(ids, F.col("_k") == F.col("_id"), "left_semi").groupBy("table_name").agg(F.sum("n").alias("n"))
    pairs = anomalies.groupBy(F.col(key).alias("_k"), F.col("resolved_by").alias("_r")).agg(F.count(F.lit(1)).alias("n"))
    one, two = ids.withColumnRenamed("_id", "_i1"), ids.withColumnRenamed("_id", "_i2")
    hit = (
        pairs.join(one, F.col("_k") == F.col("_i1"), "left")
        .join(two, F.col("_r") == F.col("_i2"), "left")
        .where("_i1 is not null or _i2 is not null")
        .agg(F.lit("anomalies").alias("table_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    )
    names = removed.sparkSession.createDataFrame([(n,) for n in children], "table_name string")
    filled = names.join(plain, "table_name", "left").select("table_name", F.coalesce("n", F.lit(0)).alias("n"))
    return filled.unionByName(hit).select("table_name", F.col("n").alias("dependent_rows"))


def cascade_delete(removed: DataFrame, tables: dict[str, DataFrame], key: str = "employee_id") -> dict[str, DataFrame]:
    """Every table without the rows of removed people; anomalies also lose those they resolved."""
    ids = removed.select(F.col(key).alias("_id")).distinct()
    out = {}
    for name, df in tables.items():
        kept = df.join(ids, df[key] == F.col("_id"), "left_anti")
        if "resolved_by" in df.columns:
            kept = kept.join(ids, kept["resolved_by"] == F.col("_id"), "left_anti")
        out[name] = kept
    return out


# ---------------------------------------------------------------- rates and inventories


def duplicate_rate(activities: DataFrame, limit: float = 50.0) -> DataFrame:
    """Share of flagged duplicates in percent, and whether it stays under the limit."""
    flagged = F.coalesce(F.col("is_duplicate"), F.lit(False))
    return _rate(activities, flagged, "marked", limit, below=True)


def link_rate(people: DataFrame, limit: float = 80.0) -> DataFrame:
    """Share of people linked to the master list, and whether it reaches the limit."""
    return _rate(people, F.col("master_id").isNotNull(), "linked", limit, below=False)


def _rate(df: DataFrame, condition: Column, label: str, limit: float, below: bool) -> DataFrame:
    counts = df.agg(count_where(condition).alias(label), F.count(F.lit(1)).alias("total"))
    share = F.try_divide(F.col(label).cast("double"), F.col("total").cast("double")) * 100.0
    rate = F.coalesce(share, F.lit(0.0 if below else 100.0))
    passed = rate < F.lit(limit) if below else rate >= F.lit(limit)
    return counts.select(label, "total", rate.alias("rate"), passed.alias("passed"))


def import_histogram(df: DataFrame, created_at: str) -> DataFrame:
    """Rows created per date and hour; over 20 is massive, over 10 is high."""
    n = F.col("created")
    return (
        df.groupBy(F.to_date(created_at).alias("import_date"), F.hour(created_at).alias("import_hour"))
        .agg(F.count(F.lit(1)).alias("created"))
        .withColumn("note", F.when(n > 20, "massive").when(n > 10, "high").otherwise(""))
        .orderBy(F.desc("import_date"), F.desc("import_hour"))
    )


def active_inventory(dimensions: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Active and total rows of each dimension."""
    return union_all(
        [
            df.agg(F.lit(name).alias("dimension"), count_where(active).alias("active"), F.count(F.lit(1)).alias("total"))
            for name, (df, active) in dimensions.items()
        ]
    )


def queue_states(queue: DataFrame) -> DataFrame:
    """Association queue by state."""
    states = ["pending", "assigned", "rejected"]
    return queue.agg(
        F.count(F.lit(1)).alias("total"), *[count_where(F.col("status") == s).alias(s) for s in states]
    )


def table_inventory(tables: dict[str, DataFrame], master: set[str]) -> DataFrame:
    """Row count per table and whether it belongs to the master schema."""
    return union_all(
        [
            df.agg(
                F.lit(name).alias("table_name"),
                F.lit("master" if name in master else "legacy").alias("class"),
                F.count(F.lit(1)).alias("rows"),
            )
            for name, df in tables.items()
        ]
    )


def migration_dry_run(entities: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Distinct filled names per entity.  Names are grouped first, then counted."""

    def one(entity: str, df: DataFrame, keys: list[str]) -> DataFrame:
        filled = F.col(keys[0]).isNotNull() & (F.col(keys[0]) != "")
        return df.where(filled).select(*keys).distinct().agg(
            F.lit(entity).alias("entity"), F.count(F.lit(1)).alias("distinct_names")
        )

    return union_all([one(e, df, keys) for e, (df, keys) in entities.items()])


def integrity_summary(checks: list[DataFrame]) -> DataFrame:
    """Named check counts and their sum; each input has columns check_name and issues."""
    rows = union_all([c.select("check_name", F.col("issues").cast("bigint").alias("issues")) for c in checks])
    total = rows.agg(F.lit("total").alias("check_name"), F.coalesce(F.sum("issues"), F.lit(0)).alias("issues"))
    return rows.unionByName(total)


def broken_rows(activities: DataFrame, check: str) -> DataFrame:
    """Activities with an end before the start or no positive duration."""
    broken = (F.col("end_ts") < F.col("start_ts")) | (F.col("duration_hours") <= 0)
    return activities.agg(F.lit(check).alias("check_name"), count_where(broken).alias("issues"))


def as_check(counted: DataFrame, column: str, check: str | None = None) -> DataFrame:
    name = F.lit(check) if check is not None else F.col("check_name")
    return counted.select(name.alias("check_name"), F.col(column).alias("issues"))


def kpi_rows_per_employee(employees: DataFrame, kpi: DataFrame) -> DataFrame:
    """KPI rows of every employee, zero included."""
    counts = kpi.groupBy("employee_id").agg(F.count(F.lit(1)).alias("n"))
    return employees.join(counts, "employee_id", "left").select(
        "employee_id", "full_name", F.coalesce("n", F.lit(0)).alias("kpi_rows")
    )
