"""Contiguity of files and segments: runs, seams, nominations, orders and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def file_runs(extents: DataFrame) -> DataFrame:
    """Islands of a file whose extents follow each other in the file and in one segment."""
    w = Window.partitionBy("inode").orderBy("extent")
    before = lambda k: F.lag(k).over(w)
    joined = (
        (c("extent") == before("extent") + 1) & (c("epoch") == before("epoch")) & (c("counter") == before("counter"))
        & (c("frame_index") == before("frame_index") + 1) & (c("byte_offset") == before("byte_offset") + before("byte_len"))
    )
    rows = extents.withColumn("run", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(w))
    return rows.groupBy("inode", "run").agg(
        F.min("extent").alias("first_extent"), F.max("extent").alias("last_extent"), F.first("epoch").alias("epoch"), F.first("counter").alias("counter"), F.min("byte_offset").alias("byte_offset"), F.sum("byte_len").alias("byte_len")
    )


def segment_runs(frames: DataFrame) -> DataFrame:
    """Islands of a segment: frames next to each other."""
    w = Window.partitionBy("epoch", "counter").orderBy("frame_index")
    joined = (c("frame_index") == F.lag("frame_index").over(w) + 1) & (c("byte_offset") == F.lag("byte_offset").over(w) + F.lag("byte_len").over(w))
    rows = frames.withColumn("run", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(w))
    return rows.groupBy("epoch", "counter", "run").agg(F.count("*").alias("frames"), F.min("byte_offset").alias("byte_offset"), F.sum("byte_len").alias("byte_len"))


def seams(runs: DataFrame) -> DataFrame:
    """Places where a file's next run starts at the end of the one before, in another place; holes are no seams."""
    w = Window.partitionBy("inode").orderBy("first_extent")
    after = lambda k: F.lead(k).over(w)
    rows = runs.select("inode", c("last_extent").alias("extent"), c("epoch").alias("epoch_a"), c("counter").alias("counter_a"), after("epoch").alias("epoch_b"), after("counter").alias("counter_b"), after("first_extent").alias("next_"))
    return rows.where(c("next_") == c("extent") + 1).drop("next_")


def nominations(touched: DataFrame, least: int = 2, most: int = 16) -> DataFrame:
    """Segments of reads that touch at least ``least`` of them; the first ``most`` of a read, in the order of its extents."""
    once = touched.groupBy("event_id", "epoch", "counter").agg(F.min("extent").alias("first"))
    n = F.count("*").over(Window.partitionBy("event_id"))
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy("first", "epoch", "counter"))
    return once.withColumn("fanout", n).withColumn("rank", rank).where((c("fanout") >= least) & (c("rank") <= most)).select("event_id", "epoch", "counter", "fanout")


def read_seams(touched: DataFrame, most: int = 16) -> DataFrame:
    """Pairs of segments between which reads cross: where an extent follows in the file, but not as the next frame of one segment.

    touched: extents of reads with ``epoch``, ``counter``, ``frame_index``, ``byte_offset`` and ``byte_len``, without holes.
    A pair has its lesser segment first and may be a segment with itself; each read names a pair once, and its first ``most``.
    """
    w = Window.partitionBy("event_id", "inode").orderBy("extent")
    before = lambda k: F.lag(k).over(w)
    here, there = F.struct("epoch", "counter"), F.struct(before("epoch").alias("epoch"), before("counter").alias("counter"))
    together = (here == there) & (c("frame_index") == before("frame_index") + 1) & (c("byte_offset") == before("byte_offset") + before("byte_len"))
    follows = c("extent") == before("extent") + 1
    rows = touched.select("event_id", "inode", "extent", F.least(here, there).alias("a"), F.greatest(here, there).alias("b"), (follows & ~together).alias("seam")).where("seam")
    once = rows.groupBy("event_id", "a", "b").agg(F.min("extent").alias("first"))
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy("first", "a", "b"))
    once = once.withColumn("rank", rank).where(c("rank") <= most)
    return once.select("event_id", c("a.epoch").alias("epoch_a"), c("a.counter").alias("counter_a"), c("b.epoch").alias("epoch_b"), c("b.counter").alias("counter_b"), c("first").alias("extent"))


def ranked(segments: DataFrame, limit: int) -> DataFrame:
    """The most fragmented segments: live permille, then age.  A bounded, exact top-k."""
    return segments.orderBy("permille", "epoch", "counter").limit(limit)


def budget_fill(segments: DataFrame, budget: int, slots: int) -> DataFrame:
    """Segments in rank order while the live bytes before them stay below the budget, and slots last.

    ``slots`` rows at most can be taken, so only those are looked at in order.
    """
    top = ranked(segments, slots)
    w = Window.partitionBy(F.lit(0)).orderBy("permille", "epoch", "counter")  # ``slots`` rows
    rows = top.withColumn("place", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("live").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.where(c("before") < budget)


def repack_order(extents: DataFrame, partitions: int = 8) -> DataFrame:
    """Extents clustered by file for writing: range-partitioned and sorted, with no global sort."""
    return extents.repartitionByRange(partitions, "inode", "extent").sortWithinPartitions("inode", "extent")


def first_seen(events: DataFrame, key: list[str], seq: str, keep: int) -> DataFrame:
    """The newest ``keep`` distinct keys by first sight (a bounded first-in-first-out set without re-entry)."""
    seen = events.groupBy(*key).agg(F.min(seq).alias("first_seen"))
    return seen.orderBy(F.desc("first_seen"), *key).limit(keep)


def tombstone_round(tombstones: DataFrame, extents: int, entries: int, extent_bytes: int = 32768) -> DataFrame:
    """What one collection round takes from the oldest tombstones, the last one in part.

    A round looks at ``entries`` tombstones at most.
    """
    rows = tombstones.orderBy("ts", "inode_id").limit(entries).withColumn("extents", F.ceil(c("remaining_size") / extent_bytes))
    w = Window.partitionBy(F.lit(0)).orderBy("ts", "inode_id")  # ``entries`` rows
    before = F.coalesce(F.sum("extents").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).where((c("before") < extents) | (c("extents") == 0) & (c("before") <= extents))
    take = F.least(c("extents"), F.lit(extents) - c("before"))
    left = F.when(take == c("extents"), F.lit(0).cast("long")).otherwise(F.least((c("extents") - take) * extent_bytes, c("remaining_size")))
    return rows.select("ts", "inode_id", "extents", take.alias("taken"), left.alias("remaining_after"))


def truncate(extents: DataFrame, sizes: DataFrame, extent_bytes: int = 32768) -> tuple[DataFrame, DataFrame]:
    """Extents left after files are cut to a size, and what segments lose by it."""
    rows = extents.join(sizes.select("inode", "new_size"), "inode", "left")
    gone = c("extent") >= F.ceil(c("new_size") / extent_bytes)
    kept = rows.where(F.coalesce(~gone, F.lit(True))).drop("new_size")
    debit = rows.where(gone).groupBy("epoch", "counter").agg((-F.sum("byte_len")).alias("d_live"))
    return kept, debit
