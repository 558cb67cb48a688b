"""All registered queries."""

from __future__ import annotations

from shiftlens.plans import (
    dedup_queries,
    feed_queries,
    incremental_queries,
    kpi_queries,
    people_queries,
    quality_queries,
    report_queries,
    sink_queries,
    validation_queries,
)
from shiftlens.plans.registry import Query

MODULES = [
    kpi_queries,
    validation_queries,
    report_queries,
    dedup_queries,
    feed_queries,
    people_queries,
    quality_queries,
    sink_queries,
    incremental_queries,
]


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in MODULES:
        for name, query in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query registered twice: {name}")
            out[name] = query
    return out
