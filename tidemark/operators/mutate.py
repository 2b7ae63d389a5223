"""File operations as changes of tables: each gives the rows that a batch of operations leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import BUCKET, STEP, bucketed, level_list
from tidemark.operators.namespace import is_ancestor

c = F.col


def create(entries: DataFrame, new: DataFrame) -> DataFrame:
    """New entries with the cookies that follow those of their directories."""
    top = entries.groupBy("dir_id").agg(F.max("cookie").alias("top"))
    rank = F.row_number().over(Window.partitionBy("dir_id").orderBy("inode_id"))
    return new.join(top, "dir_id", "left").select("dir_id", "name", "inode_id", (F.coalesce("top", F.lit(2)) + rank).cast("long").alias("cookie"))


def write_sizes(inodes: DataFrame, writes: DataFrame) -> DataFrame:
    """Sizes of written files: the end of the last write where that is further."""
    end = writes.groupBy(c("inode").alias("inode_id")).agg(F.max(c("offset") + c("length")).alias("end"))
    rows = inodes.where("kind = 'file'").join(end, "inode_id")
    return rows.select("inode_id", F.greatest("size", "end").alias("size"), (F.greatest("size", "end") - c("size")).alias("growth"))


def read_clamped(inodes: DataFrame, reads: DataFrame) -> DataFrame:
    """Bytes that reads get, and whether they reach the end of the file."""
    rows = reads.join(inodes.where("kind = 'file'").select(c("inode_id").alias("inode"), "size"), "inode")
    end = c("offset") + c("length")
    return rows.select("event_id", F.greatest(F.least(end, c("size")) - c("offset"), F.lit(0)).alias("bytes"), (end >= c("size")).alias("eof"))


def trim(extents: DataFrame, ranges: DataFrame, extent_bytes: int = 32768) -> DataFrame:
    """Whole extents inside trimmed ranges, per file."""
    first, last = F.ceil(c("offset") / extent_bytes), F.floor((c("offset") + c("length")) / extent_bytes) - 1
    asked = ranges.select("inode", first.alias("first"), (last + 1).alias("stop")).where("first < stop")
    levels = level_list((asked, "first", "stop"))
    if not levels:
        return extents.limit(0).groupBy("inode").agg(F.count("*").alias("dropped"), F.sum("byte_len").alias("bytes"))
    wide = bucketed(asked, "first", "stop", levels, "own", "from_").where("own").select("inode", "level", "bucket", "first", "stop")
    # every extent is looked for once at each level that occurs, whatever the ranges span
    at = extents.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("bucket", F.expr(f"shiftright(extent, level * {STEP} + {BUCKET.bit_length() - 1})"))
    hit = at.join(wide, ["inode", "level", "bucket"]).where((c("extent") >= c("first")) & (c("extent") < c("stop"))).select(*extents.columns).dropDuplicates(["inode", "extent"])
    return hit.groupBy("inode").agg(F.count("*").alias("dropped"), F.sum("byte_len").alias("bytes"))


def link(inodes: DataFrame, new: DataFrame) -> DataFrame:
    """Link counts after new names; an object with several names has no parent."""
    more = new.groupBy("inode_id").agg(F.count("*").alias("n"))
    rows = inodes.where("kind <> 'directory'").join(more, "inode_id")
    return rows.select("inode_id", (c("nlink") + c("n")).alias("nlink"), F.when(c("nlink") + c("n") == 1, c("parent")).alias("parent"))


def remove(inodes: DataFrame, gone: DataFrame, opened: Column) -> DataFrame:
    """What becomes of removed objects: other names keep them, open files wait, files with data leave a tombstone."""
    rows = inodes.where("kind <> 'directory'").join(gone.distinct(), "inode_id", "left_semi")
    fate = F.when(c("nlink") > 1, "unlinked").when(opened, "orphan").when((c("kind") == "file") & (c("size") > 0), "tombstone").otherwise("gone")
    return rows.select("inode_id", fate.alias("fate"))


def rename(inodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves to a directory that is not below what is moved."""
    asked = moves.select(c("inode_id").alias("ancestor"), c("to_dir").alias("inode_id")).distinct()
    loops = is_ancestor(inodes, asked).where("yes").select(c("ancestor").alias("inode_id"), c("inode_id").alias("to_dir"))
    return moves.join(loops, ["inode_id", "to_dir"], "left_anti").select(c("dir_id").alias("from_dir"), "inode_id", "to_dir")


def reclaim_orphans(orphans: DataFrame, inodes: DataFrame) -> DataFrame:
    return orphans.join(inodes.select("inode_id", "size"), "inode_id", "left").select("inode_id", F.coalesce("size", F.lit(0)).alias("bytes"))


def shrink_tombstones(tombstones: DataFrame, extents: int, extent_bytes: int = 32768) -> DataFrame:
    """Remaining sizes after so many extents are deleted from the end of each file."""
    n = F.ceil(c("remaining_size") / extent_bytes)
    return tombstones.select("inode_id", "remaining_size", (F.greatest(n - extents, F.lit(0)) * extent_bytes).alias("remaining_after"))
