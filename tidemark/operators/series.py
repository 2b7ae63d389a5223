"""Counters over time: rates, idleness, thresholds, quiescence.

``by`` names the columns that tell several series apart; a single long series is cut by time,
and its parts hand on what the next one has to know.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import previous, running_max

c = F.col


def rates(rows: DataFrame, time: str, counters: list[str], by: list[str] = [], scale: float = 1.0) -> DataFrame:
    """dt and the rise per time unit of each counter since the sample before; resets count as 0."""
    out = previous(rows, [time], [time, *counters], by).withColumn("dt", c(time) - c(f"prev_.{time}"))
    for k in counters:
        rise = F.greatest(c(k) - c(f"prev_.{k}"), F.lit(0))
        out = out.withColumn(f"{k}_rate", F.when(c("dt") > 0, rise * F.lit(scale) / c("dt")).when(c("dt") <= 0, F.lit(0.0)))
    return out.drop("prev_")


def idle(rows: DataFrame, time: str, counters: list[str], by: list[str] = []) -> DataFrame:
    """Whether no counter rose since the sample before; the first sample is not idle."""
    still = F.lit(True)
    for k in counters:
        still = still & (c(k) - c(f"prev_.{k}") <= 0)
    return previous(rows, [time], counters, by).withColumn("idle", F.coalesce(still, F.lit(False))).drop("prev_")


def crossings(rows: DataFrame, time: str, high: Column, by: list[str] = []) -> DataFrame:
    """Samples at which a condition becomes true."""
    out = previous(rows.withColumn("high_", high), [time], ["high_"], by)
    return out.where(c("high_") & ~F.coalesce(c("prev_.high_"), F.lit(False))).drop("high_", "prev_")


def quiescent(rows: DataFrame, time: str, value: str, quiet: int, by: list[str] = []) -> DataFrame:
    """Whether a value has not changed for ``quiet`` time units."""
    out = previous(rows, [time], [value], by)
    out = out.withColumn("changed_", F.when(c("prev_").isNull() | (c(value) != c(f"prev_.{value}")), c(time)))
    out = running_max(out.drop("prev_"), [time], c("changed_"), by)
    return out.withColumn("unchanged_for", c(time) - c("top_")).withColumn("quiet", c("unchanged_for") >= quiet).drop("changed_", "top_")


def newest(rows: DataFrame, time: str, n: int, by: list[str] = []) -> DataFrame:
    """The last n samples of each series."""
    if not by:
        return rows.orderBy(F.desc(time)).limit(n)
    w = Window.partitionBy(*by).orderBy(F.desc(time))
    return rows.withColumn("rn_", F.row_number().over(w)).where(c("rn_") <= n).drop("rn_")
