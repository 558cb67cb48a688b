"""Thresholds and rates, and the typed key/value table they can be loaded from."""

from __future__ import annotations

from dataclasses import dataclass, fields
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

# Configuration keys, their type and default.
CONFIG_DEFAULTS = {
    "costo_dipendente_default": ("80.00", "float", "costi"),
    "ore_lavorative_giornaliere": ("8", "integer", "parametri"),
    "tolleranza_ore_max": ("1.0", "float", "validazioni"),
    "tariffa_oraria_standard": ("50.00", "float", "ricavi"),
    "alert_ore_minime": ("7", "integer", "alert"),
    "vehicle_cost_per_km": ("0.35", "float", "costi"),
    "efficiency_threshold_warning": ("70", "integer", "kpi"),
    "efficiency_threshold_critical": ("50", "integer", "kpi"),
    "profit_threshold_warning": ("-20.00", "float", "kpi"),
    "correlation_threshold_good": ("85", "integer", "validazioni"),
}

# Which configuration key feeds which Settings field.
_FIELD_OF_KEY = {
    "costo_dipendente_default": "default_daily_cost",
    "ore_lavorative_giornaliere": "hours_per_day",
    "tolleranza_ore_max": "tolerance_hours",
    "tariffa_oraria_standard": "hourly_rate",
    "alert_ore_minime": "min_hours",
    "vehicle_cost_per_km": "cost_per_km",
    "efficiency_threshold_warning": "efficiency_warning",
    "efficiency_threshold_critical": "efficiency_critical",
    "profit_threshold_warning": "profit_warning",
    "correlation_threshold_good": "correlation_good",
}


@dataclass(frozen=True)
class Settings:
    """Rates and thresholds used by the KPI, validation and report jobs."""

    default_daily_cost: Decimal = Decimal("80.00")
    hours_per_day: Decimal = Decimal("8")
    tolerance_hours: Decimal = Decimal("1.0")
    hourly_rate: Decimal = Decimal("50.00")
    min_hours: Decimal = Decimal("7")
    cost_per_km: Decimal = Decimal("0.35")
    efficiency_warning: Decimal = Decimal("70")
    efficiency_critical: Decimal = Decimal("50")
    profit_warning: Decimal = Decimal("-20.00")
    correlation_good: Decimal = Decimal("85")
    efficiency_cap: Decimal = Decimal("150")

    @classmethod
    def from_config(cls, config: DataFrame) -> "Settings":
        """Read the known keys of a config table (one row, ten columns at most)."""
        row = config_row(config, sorted(_FIELD_OF_KEY)).first()
        known = {f.name for f in fields(cls)}
        values = {}
        for key, field in _FIELD_OF_KEY.items():
            if row is not None and row[key] is not None and field in known:
                values[field] = Decimal(row[key])
        return cls(**values)


def typed_config(config: DataFrame, category: str | None = None) -> DataFrame:
    """Config rows with one column per type; only the column of the row's type is set."""
    raw, kind = F.col("value"), F.lower("type")
    out = config
    if category is not None:
        out = out.where(F.col("category") == category)
    return out.select(
        "key",
        "value",
        "type",
        "category",
        F.when(kind == "integer", _leading_number(raw).try_cast("double").cast("bigint")).alias("as_integer"),
        F.when(kind == "float", F.coalesce(_leading_number(raw).try_cast("double"), F.lit(0.0))).alias("as_float"),
        F.when(kind == "boolean", ~F.coalesce(raw, F.lit("")).isin("", "0")).alias("as_boolean"),
        F.when(kind == "json", F.try_parse_json(raw)).alias("as_json"),
        F.when(~kind.isin("integer", "float", "boolean", "json"), raw).alias("as_string"),
    )


def _leading_number(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([+-]?\d*\.?\d+)", 1)


def config_row(config: DataFrame, keys: list[str]) -> DataFrame:
    """One row, one column per requested key (NULL when absent).

    The key list bounds the pivot, so the row can be broadcast or read on the driver.
    """
    return config.where(F.col("key").isin(keys)).agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys]
    )


def default_config(spark) -> DataFrame:
    rows = [(k, v, t, c) for k, (v, t, c) in CONFIG_DEFAULTS.items()]
    return spark.createDataFrame(rows, "key string, value string, type string, category string")
