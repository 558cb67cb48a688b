"""Mixing sources to target weights by iterative proportional fitting.

The tokens of all documents are summed per cell (source, language, topic).  Raking multiplies the
cells' token weights, one margin after the other, until the weighted tokens meet the target share
of every source, every language and every topic.  A cell's weight over its tokens says how much
more or less often its documents should be seen; scaled so that the expected tokens meet the
budget (a share ``rate`` of all tokens), and capped at 1, it is the probability with which each of
its documents is kept.  A document's draw is a hash of its id, so it never depends on order.

Everything is DataFrame work: the cells are aggregated before they are shuffled, margins are
grouped sums of the cell table, and only the loop control (an error, a scale) reaches the driver.

Null sources, languages and topics count as the value ``(none)``.  Null and empty texts have no
tokens; they are kept with the probability of their cell, 1 where the whole cell has no tokens.
Repeated rows share their id's draw; rows without doc_id are drawn by their text.  Targets for
values that do not occur are left out and the rest is scaled to 1; values without a target get
share 0.  Targets that contradict one another (a margin that cannot be met) end after
``iterations`` rounds with the last margin met.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftlens.session import cut_lineage

MARGINS = ("source", "lang", "topic")
NONE = "(none)"
DRAWS = 1 << 52


@dataclass(frozen=True)
class MixParams:
    flatten: float = 0.7  # default target of a value: its share to this power
    rate: float = 0.75  # expected share of all tokens that is kept
    iterations: int = 40
    error: float = 1e-6  # largest correction of a margin in the last round
    seed: int = 17
    broadcast_cells: int = 100_000  # the cell table is broadcast up to this measured size


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def form_of(text: Column) -> Column:
    """A topic for tables without one: the text's form, read from the whole text."""
    text = F.coalesce(text, F.lit(""))
    words = F.greatest(word_count(text), F.lit(1))
    bars = F.regexp_count(text, F.lit(r" \| "))
    marks = F.regexp_count(text, F.lit(r"[^\w\s]{2,}(?=\s|$)"))
    digits = F.regexp_count(text, F.lit(r"\d+"))
    return (
        F.when(bars * 4 > words, "table")
        .when(marks * 4 > words, "marked")
        .when(digits * 20 > words, "figures")
        .when(F.length(text) < 1000, "short")
        .otherwise("prose")
    )


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with _source, _lang, _topic, _tokens and _draw; a topic column is used if there is one."""
    topic = F.col("topic") if "topic" in docs.columns else form_of(F.col("text"))
    named = {
        "_source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
        "_lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
        "_topic": F.coalesce(topic, F.lit(NONE)),
        "_tokens": word_count(F.col("text")),
    }
    return docs.withColumns(named)


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*[F.col(f"_{m}").alias(m) for m in MARGINS]).agg(
        F.sum("_tokens").cast("double").alias("tokens")
    )


def default_targets(cells: DataFrame, flatten: float) -> dict[str, DataFrame]:
    """Per margin (value, target): the token shares to the power ``flatten``."""
    return {
        m: cells.groupBy(F.col(m).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(flatten)).alias("target"))
        for m in MARGINS
    }


def scaled_targets(cells: DataFrame, targets: dict[str, DataFrame], total: float) -> DataFrame:
    """(margin, value, target): target tokens of all values that have tokens, ``total`` per margin."""
    parts = []
    for m in MARGINS:
        used = cells.where("tokens > 0").select(F.col(m).alias("value")).distinct()
        known = used.join(targets[m].select("value", "target"), "value", "left").select(
            F.lit(m).alias("margin"), "value", F.coalesce(F.col("target").cast("double"), F.lit(0.0)).alias("target")
        )
        parts.append(known)
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sums = every.groupBy("margin").agg(F.sum("target").alias("sum"))
    return every.join(F.broadcast(sums), "margin").select(  # three rows
        "margin", "value", (F.col("target") * total / F.col("sum")).alias("target")
    )


def raked(cells: DataFrame, targets: dict[str, DataFrame], params: MixParams) -> DataFrame:
    """``cells`` with ``weight``: raked tokens.

    Each cell carries the targets of its three values, so a round is three sums over windows of the
    cells and one small job, without joins.  Cells are distinct combinations of values, however many
    documents there are.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    if total == 0:
        return cells.withColumn("weight", F.col("tokens"))
    wanted = cut_lineage(scaled_targets(cells, targets, total))
    for m in MARGINS:
        goal = wanted.where(F.col("margin") == m).select(F.col("value").alias(m), F.col("target").alias(f"goal_{m}"))
        cells = cells.join(goal, m, "left")
    cells = cut_lineage(cells.withColumn("weight", F.col("tokens")))
    columns = [*MARGINS, "tokens", *[f"goal_{m}" for m in MARGINS]]
    for _ in range(params.iterations):
        step = cells.select(*columns, "weight", F.lit(0.0).alias("miss"))
        for m in MARGINS:
            have = F.sum("weight").over(Window.partitionBy(m))
            step = step.withColumn("ratio", F.when(have > 0, F.coalesce(F.col(f"goal_{m}"), F.lit(0.0)) / have).otherwise(1.0))
            step = step.select(
                *columns,
                (F.col("weight") * F.col("ratio")).alias("weight"),
                F.greatest("miss", F.abs(F.col("ratio") - 1)).alias("miss"),
            )
        cells = cut_lineage(step)
        if (cells.agg(F.max("miss")).first()[0] or 0.0) <= params.error:
            break
    return cells.select(*MARGINS, "tokens", "weight")


def scale_for(cells: DataFrame, rate: float, steps: int = 50) -> float:
    """The factor by which capped ratios keep ``rate`` of all tokens on average."""
    ratio = F.col("weight") / F.col("tokens")
    usable = cells.where("tokens > 0")
    total = usable.agg(F.sum("tokens")).first()[0] or 0.0
    scale = rate
    for _ in range(steps):
        full, rest = usable.agg(
            F.sum(F.when(ratio * scale >= 1, F.col("tokens")).otherwise(0.0)),
            F.sum(F.when(ratio * scale < 1, F.col("weight")).otherwise(0.0)),
        ).first()
        if not rest:
            return scale
        new = (rate * total - full) / rest
        if abs(new - scale) <= 1e-9 * scale:
            return new
        scale = new
    return scale


def mixing_weights(rows: DataFrame, params: MixParams, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(source, lang, topic, tokens, weight, probability) per cell of ``measured`` rows."""
    cells = cut_lineage(cells_of(rows))
    cells = raked(cells, targets or default_targets(cells, params.flatten), params)
    scale = scale_for(cells, params.rate)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(None))
    return cells.withColumn("ratio", ratio).withColumn(
        "probability", F.coalesce(F.least(F.lit(1.0), F.col("ratio") * scale), F.lit(1.0))
    )


def mix(docs: DataFrame, params: MixParams = MixParams(), targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``docs`` with _source, _lang, _topic, _tokens, _weight, _probability and _kept."""
    rows = measured(docs)
    weights = cut_lineage(mixing_weights(rows, params, targets)).select(
        *[F.col(m).alias(f"_{m}") for m in MARGINS],
        F.coalesce("ratio", F.lit(1.0)).alias("_weight"),
        F.col("probability").alias("_probability"),
    )
    if weights.count() <= params.broadcast_cells:
        weights = F.broadcast(weights)
    key = F.coalesce(F.col("doc_id"), F.xxhash64("text"))
    draw = F.pmod(F.xxhash64(key, F.lit(params.seed)), F.lit(DRAWS)) / F.lit(float(DRAWS))
    return rows.join(weights, [f"_{m}" for m in MARGINS]).withColumn("_kept", draw < F.col("_probability"))
