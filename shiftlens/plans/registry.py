"""What a registered query is: a Spark plan, its output columns and its reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.plans.domain import Domain
from shiftlens.plans.oracles import EDGE_TYPES, oracle, parse_columns


@dataclass(frozen=True)
class Query:
    columns: str
    build: Callable[[Domain], DataFrame]
    sql: str | None = None
    frames: list[str] = field(default_factory=list)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Domain(spark, sf_dir))
        return df.select(
            *[F.col(n).cast(EDGE_TYPES[k][0]).alias(n) for n, k in parse_columns(self.columns)]
        )

    def oracle(self) -> str | None:
        return None if self.sql is None else oracle(self.columns, self.frames, self.sql)
