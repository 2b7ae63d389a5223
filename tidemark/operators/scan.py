"""Reads of ordered tables: points, ranges, prefixes, pages, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_get(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of all asked keys; one equi-join for a whole batch of lookups."""
    return table.join(keys.select(*on).distinct(), on)


def durable(log: DataFrame, watermark: int | Column, seq: str = "seqno") -> DataFrame:
    """The part of a change log up to a durable sequence number."""
    return log.where(F.col(seq) <= watermark)


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write per key; keys whose last write is a delete are gone."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("rn_", F.row_number().over(last)).where("rn_ = 1").drop("rn_").where("op <> 'delete'")


def views(log: DataFrame, key: str, order: list[str], watermark: int, seq: str = "seqno") -> DataFrame:
    """Each key as readers see it and as it would be after a crash: (key, value, durable, durable_value).

    durable: whether the visible value has reached the durable sequence number; a deleted value is null, and a key that
    neither view has is left out.
    """
    at, last = F.struct(*order), F.struct("op", "value", seq)
    old = F.col(seq) <= watermark
    both = log.groupBy(key).agg(F.max_by(last, at).alias("v"), F.max_by(F.when(old, last), F.when(old, at)).alias("d"))
    held = lambda x: F.when(F.col(f"{x}.op") != "delete", F.col(f"{x}.value"))
    rows = both.where((F.col("v.op") != "delete") | (F.col("d.op") != "delete"))
    return rows.select(key, held("v").alias("value"), (F.col(f"v.{seq}") <= watermark).alias("durable"), held("d").alias("durable_value"))


def range_scan(table: DataFrame, key: list[str], low: list, high: list) -> DataFrame:
    """Rows with low <= key < high, in key order; compound keys compare as structs."""
    at = F.struct(*key)
    bound = lambda xs: F.struct(*[F.lit(x).cast(table.schema[c].dataType).alias(c) for c, x in zip(key, xs, strict=True)])
    first = (F.col(key[0]) >= low[0]) & (F.col(key[0]) <= high[0])  # what a Parquet scan can prune by
    return table.where(first & (at >= bound(low)) & (at < bound(high))).orderBy(*key)


def prefix_scan(table: DataFrame, prefix: dict[str, object], seek: dict[str, object], limit: int | None = None) -> DataFrame:
    """Rows of a key prefix from a resume position on, in order."""
    for c, v in prefix.items():
        table = table.where(F.col(c) == v)
    for c, v in seek.items():
        table = table.where(F.col(c) >= v)
    out = table.orderBy(*seek)
    return out.limit(limit) if limit is not None else out


def directory_page(entries: DataFrame, dir_id: int, parent: int, cookie: int, limit: int) -> DataFrame:
    """A page of a listing: "." has cookie 1, ".." 2, entries 3 and more; has_more tells of a next page."""
    spark = entries.sparkSession
    dots = spark.range(1).select(F.inline(F.array(F.struct(F.lit(1).cast("long").alias("cookie"), F.lit(".").alias("name"), F.lit(dir_id).cast("long").alias("inode_id")), F.struct(F.lit(2).cast("long").alias("cookie"), F.lit("..").alias("name"), F.lit(parent).cast("long").alias("inode_id")))))
    own = entries.where(F.col("dir_id") == dir_id).select("cookie", "name", "inode_id")
    page = dots.unionAll(own).where(F.col("cookie") > cookie).orderBy("cookie").limit(limit + 1)
    whole = Window.partitionBy(F.lit(0))  # limit + 1 rows
    rank = F.row_number().over(whole.orderBy("cookie"))
    return page.select("cookie", "name", "inode_id", (F.count("*").over(whole) > limit).alias("has_more"), rank.alias("rank_")).where(F.col("rank_") <= limit).drop("rank_")


def pages(entries: DataFrame, size: int) -> DataFrame:
    """Every directory cut into pages: first and last cookie and rows of each."""
    place = F.row_number().over(Window.partitionBy("dir_id").orderBy("cookie")) - 1
    return entries.withColumn("page", F.floor(place / size).cast("long")).groupBy("dir_id", "page").agg(F.min("cookie").alias("first_cookie"), F.max("cookie").alias("last_cookie"), F.count("*").alias("entries"))
