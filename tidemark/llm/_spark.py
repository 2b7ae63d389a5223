"""Session helpers of the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import scratch_root

#: A side is broadcast only when it has been counted and is no larger than this.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: Rows of an Arrow batch in stages that are written.
BATCH_ROWS = 1000
#: Estimates from here on mean that Spark does not know a size.
UNKNOWN_BYTES = 1 << 52
#: Text bytes that one shuffle partition is sized for.
PARTITION_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The application's folder below the one that driver and executors share (spark.checkpoint.dir); it goes with the application."""
    return scratch_root(spark)


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read it again.

    While it is written, Arrow batches are small, so that Python workers hold little.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    had = spark.conf.get(key)
    spark.conf.set(key, BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, had)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame, factor: float = 1.0) -> int:
    """Shuffle partitions for the rows of ``df``: by their bytes, and no fewer than configured.

    Bytes are the optimizer's estimate (file sizes), or measured where it has none.
    """
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN_BYTES:
        texts = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
        size = df.select(F.sum(sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(64)))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(size * factor / PARTITION_BYTES) + 1, 1 << 20))


def _width(name: str, kind: str) -> Column:
    """Bytes of a column's value, about."""
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(name), F.lit(0))
    return F.coalesce(F.size(name), F.lit(0)) * 16 if kind.startswith("array") else F.lit(8)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a table that has been written, if its counted rows and bytes stay below the bounds."""
    n, size = df.limit(rows + 1).agg(F.count("*"), F.sum(sum((_width(*x) for x in df.dtypes), F.lit(0)))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
