"""Exact sums and stable rounding.

Hours are summed as integers of a millionth of an hour.  Integer sums do not depend
on the order of partitions, so a result is the same on one core and on a thousand
executors, and partial aggregation before the shuffle loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICRO = 1_000_000


def to_micro(value: Column) -> Column:
    """A non-negative quantity in hours -> whole millionths, half up."""
    return F.floor(value.cast("double") * F.lit(float(MICRO)) + F.lit(0.5)).cast("bigint")


def micro_sql(micro: str, scale: int = 2) -> str:
    """SQL text: whole millionths -> decimal with ``scale`` digits, half away from zero."""
    return f"cast(cast({micro} as decimal(20,0)) * cast(0.000001 as decimal(7,6)) as decimal(18,{scale}))"


def micro_to_decimal(micro: Column, scale: int = 2) -> Column:
    """Whole millionths -> decimal with ``scale`` digits, half away from zero."""
    exact = micro.cast("decimal(20,0)") * F.expr("cast(0.000001 as decimal(7,6))")
    return exact.cast(f"decimal(18,{scale})")


def half_up(value: Column, digits: int = 2) -> Column:
    """Round a double half up to ``digits`` with plain floating arithmetic."""
    factor = float(10**digits)
    return F.floor(value * F.lit(factor) + F.lit(0.5)).cast("double") / F.lit(factor)


def exact_avg(value: Column) -> Column:
    """Mean of decimals or integers: exact sum, one division at the end, NULLs skipped."""
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL, not an error, when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
