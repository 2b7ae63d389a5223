"""Looks back along one long order without putting it into one task.

Rows are range-partitioned and written once; each partition is a window of its own, and what
the partitions before it hand on is worked out over one row for each partition.  ``by`` names
the columns that tell several orders apart; then each is a window of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.sinks import kept


def _parts(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    return kept(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))


def previous(rows: DataFrame, order: Sequence[str], columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows with ``prev_``, a struct of some columns of the row before, or null for the first one."""
    before = F.lag(F.struct(*columns))
    if by:
        return rows.withColumn("prev_", before.over(Window.partitionBy(*by).orderBy(*order)))
    rows = _parts(rows, order)
    ends = rows.groupBy("part_").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("end_"))
    handed = ends.select("part_", F.lag("end_").over(Window.partitionBy(F.lit(0)).orderBy("part_")).alias("handed_"))
    rows = rows.join(F.broadcast(handed), "part_")
    return rows.withColumn("prev_", F.coalesce(before.over(Window.partitionBy("part_").orderBy(*order)), "handed_")).drop("part_", "handed_")


def running_max(rows: DataFrame, order: Sequence[str], value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows with ``top_``, the greatest value up to and with each."""
    rows = rows.withColumn("value_", value)
    if by:
        return rows.withColumn("top_", F.max("value_").over(Window.partitionBy(*by).orderBy(*order))).drop("value_")
    rows = _parts(rows, order)
    ends = rows.groupBy("part_").agg(F.max("value_").alias("end_"))
    before = Window.partitionBy(F.lit(0)).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(ends.select("part_", F.max("end_").over(before).alias("handed_"))), "part_")
    own = F.max("value_").over(Window.partitionBy("part_").orderBy(*order))
    return rows.withColumn("top_", F.greatest(own, "handed_")).drop("part_", "handed_", "value_")
