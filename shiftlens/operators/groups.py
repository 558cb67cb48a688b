"""Duplicate groups, and handing a group's summary back to its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def attach_group(df: DataFrame, keys: list[str], groups: DataFrame) -> DataFrame:
    """Left join of one summary row per key onto all rows of that key.

    ``groups`` has the key columns and the values to attach, one row per key.  Whether the
    groups are broadcast is decided by their measured size; in a shuffle join a hot key crowds
    the row side only, which adaptive execution splits.  NULL keys match each other, as in a
    grouping.
    """
    values = [c for c in groups.columns if c not in keys]
    packed = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.struct(*values).alias("_got"))
    out = df.join(packed, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys], "left")
    return out.select(*df.columns, *[F.col(f"_got.{v}").alias(v) for v in values])


def duplicate_groups(
    df: DataFrame, keys: list[str | Column], row_id: str = "id", limit: int | None = None
) -> DataFrame:
    """Groups of rows that agree on ``keys``: size, lowest and highest id.

    The members are not gathered into a list, whose length has no bound; ask
    ``duplicate_members`` for them as rows.
    """
    out = (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("duplicates"),
            F.min(row_id).alias("first_id"),
            F.max(row_id).alias("last_id"),
        )
        .where("duplicates > 1")
    )
    if limit is not None:
        out = out.orderBy(F.desc("duplicates"), "first_id").limit(limit)
    return out


def duplicate_members(df: DataFrame, keys: list[str], row_id: str = "id") -> DataFrame:
    """Every row of a duplicate group with the group's first id and size."""
    groups = duplicate_groups(df, keys, row_id).drop("last_id")
    return attach_group(df, keys, groups).where(F.col("duplicates").isNotNull())


def keep_first(df: DataFrame, keys: list[str], order: str | list[str] = "id") -> DataFrame:
    """One whole row per key, the first by ``order``; ties go to the smaller row.

    An aggregation with map-side combine, so copies collapse before the shuffle.
    """
    order = [order] if isinstance(order, str) else order
    ranked = F.struct(*order, *[c for c in df.columns if c not in order])
    first = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.min(ranked).alias("_r")
    )
    return first.select(*[F.col(f"_r.{c}").alias(c) for c in df.columns])


def mark_duplicates(
    df: DataFrame, keys: list[str], row_id: str = "id", reason: str = "exact duplicate"
) -> DataFrame:
    """Keep every row; all but the lowest id of a group are flagged with their original."""
    groups = duplicate_groups(df, keys, row_id).select(*keys, "first_id")
    joined = attach_group(df, keys, groups)
    dup = F.col("first_id").isNotNull() & (F.col(row_id) != F.col("first_id"))
    return joined.select(
        *df.columns,
        dup.alias("is_duplicate"),
        F.when(dup, F.col("first_id")).alias("original_id"),
        F.when(dup, F.lit(reason)).alias("duplicate_reason"),
        F.when(dup, F.lit(1.0)).alias("confidence"),
    )


def cleanup_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Dry run of ``mark_duplicates``: groups found and rows that would be flagged."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return sizes.agg(
        F.count(F.lit(1)).alias("analyzed"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("marked"),
    )


def duplication_factor(df: DataFrame, keys: list[str]) -> DataFrame:
    """Total rows, distinct rows, surplus and total / distinct, two digits.

    Rows are counted per key first, so there is no distinct count over the whole table.
    """
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct_rows")
    )
    factor = F.try_divide(F.col("total").cast("double"), F.col("distinct_rows").cast("double"))
    return out.select(
        "total",
        "distinct_rows",
        (F.col("total") - F.col("distinct_rows")).alias("surplus"),
        (F.floor(factor * 100 + 0.5).cast("double") / 100.0).alias("factor"),
    )
