"""Integrity checks of the namespace; each returns the rows that violate it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.namespace import met

c = F.col


def _counts(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(c(key).alias("inode_id")).agg(F.count("*").alias(name))


def dangling_entries(entries: DataFrame, inodes: DataFrame) -> DataFrame:
    """Entries that a walk from the root meets and that name no inode."""
    return met(entries).join(inodes.select("inode_id"), "inode_id", "left_anti").select("dir_id", "name", "inode_id")


def entry_counts(inodes: DataFrame, entries: DataFrame) -> DataFrame:
    dirs = inodes.where("kind = 'directory'").select("inode_id", c("entry_count").alias("stored"))
    both = dirs.join(_counts(entries, "dir_id", "actual"), "inode_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long")))
    return both.where("stored <> actual")


def link_counts(inodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Files that a walk from the root meets, and whose link count differs from the times it does."""
    files = inodes.where("kind <> 'directory'").select("inode_id", "nlink")
    return files.join(_counts(met(entries), "inode_id", "refs"), "inode_id").where("nlink <> refs")


def unreferenced(inodes: DataFrame, entries: DataFrame, orphans: DataFrame) -> DataFrame:
    """Inodes that no walk from the root meets, detached trees among them, but for known orphans."""
    left = inodes.where("inode_id <> 0").join(met(entries).select("inode_id"), "inode_id", "left_anti")
    return left.join(orphans.select("inode_id"), "inode_id", "left_anti").select("inode_id", "kind")


def usage(inodes: DataFrame, entries: DataFrame, shards: DataFrame) -> DataFrame:
    """Stored usage and that of what a walk from the root meets: two rows (metric, stored, computed)."""
    reached = inodes.where("inode_id <> 0").join(met(entries).select("inode_id"), "inode_id", "left_semi")
    computed = reached.agg(F.sum(F.when(c("kind") == "file", c("size")).otherwise(0)).alias("used_bytes"), F.count("*").alias("used_inodes")).selectExpr("stack(2, 'used_bytes', used_bytes, 'used_inodes', used_inodes) AS (metric, computed)")
    stored = shards.agg(F.sum("used_bytes").alias("used_bytes"), F.sum("used_inodes").alias("used_inodes")).selectExpr("stack(2, 'used_bytes', used_bytes, 'used_inodes', used_inodes) AS (metric, stored)")
    return stored.join(computed, "metric")


def live_tombstones(tombstones: DataFrame, inodes: DataFrame) -> DataFrame:
    return tombstones.join(inodes.select("inode_id"), "inode_id", "left_semi").select("ts", "inode_id")


def directory_links(inodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Directories whose link count is not 2 and their subdirectories."""
    dirs = inodes.where("kind = 'directory'")
    subs = _counts(entries.join(dirs.select("inode_id"), "inode_id", "left_semi"), "dir_id", "subs")
    rows = dirs.select("inode_id", "nlink").join(subs, "inode_id", "left").withColumn("expected", 2 + F.coalesce("subs", F.lit(0)))
    return rows.where("nlink <> expected").select("inode_id", "nlink", "expected")


def _file_extents(inodes: DataFrame, extents: DataFrame, extent_bytes: int) -> DataFrame:
    files = inodes.where("kind = 'file'").select(c("inode_id").alias("inode"), F.ceil(c("size") / extent_bytes).alias("wanted"))
    return files, extents.join(files, "inode")


def missing_extents(inodes: DataFrame, extents: DataFrame, extent_bytes: int = 32768) -> DataFrame:
    """Files that are not dense: fewer extents below their end than their size asks for."""
    files, rows = _file_extents(inodes, extents, extent_bytes)
    have = rows.where(c("extent") < c("wanted")).groupBy("inode").agg(F.count("*").alias("have"))
    return files.join(have, "inode", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long"))).where("have <> wanted").select(c("inode").alias("inode_id"), "wanted", "have")


def extents_past_end(inodes: DataFrame, extents: DataFrame, extent_bytes: int = 32768) -> DataFrame:
    return _file_extents(inodes, extents, extent_bytes)[1].where(c("extent") >= c("wanted")).select("inode", "extent", "wanted")


def unreadable_extents(extents: DataFrame, frames: DataFrame) -> DataFrame:
    return extents.join(frames, ["epoch", "counter", "frame_index"], "left_anti").select("inode", "extent", "epoch", "counter")


def inode_counter(inodes: DataFrame, next_id: int) -> DataFrame:
    return inodes.agg(F.max("inode_id").alias("max_id")).withColumn("next_id", F.lit(next_id).cast("long")).where("next_id <= max_id")


def ownerless_extents(extents: DataFrame, inodes: DataFrame, tombstones: DataFrame) -> DataFrame:
    left = extents.join(inodes.select(c("inode_id").alias("inode")), "inode", "left_anti").join(tombstones.select(c("inode_id").alias("inode")), "inode", "left_anti")
    return left.groupBy("inode").agg(F.count("*").alias("extents"))


def stale_embedded(scan: DataFrame, inodes: DataFrame) -> DataFrame:
    """Listing rows whose embedded attributes differ from the inode's."""
    own = inodes.select("inode_id", "size", "mode", "uid")
    rows = scan.where("e_size is not null").join(own, "inode_id")
    return rows.where(~F.struct("e_size", "e_mode", "e_uid").eqNullSafe(F.struct(c("size").alias("e_size"), c("mode").alias("e_mode"), c("uid").alias("e_uid")))).select("dir_id", "cookie", "inode_id")


def cookie_counters(cookies: DataFrame, entries: DataFrame) -> DataFrame:
    top = entries.groupBy("dir_id").agg(F.max("cookie").alias("max_cookie")).where("max_cookie > 0")
    return cookies.join(top, "dir_id").where("next_cookie <= max_cookie").select("dir_id", "next_cookie", "max_cookie")


def not_directories(rows: DataFrame, inodes: DataFrame) -> DataFrame:
    """Directory metadata of objects that are no directories (the root is one without saying)."""
    dirs = inodes.where("kind = 'directory'").select(c("inode_id").alias("dir_id"))
    return rows.where("dir_id <> 0").join(dirs, "dir_id", "left_anti").groupBy("dir_id").agg(F.count("*").alias("rows"))


def summary(inodes: DataFrame, orphans: DataFrame) -> DataFrame:
    out = inodes.agg(F.count("*").alias("inodes"), F.count_if(c("kind") == "directory").alias("directories"), F.count_if(c("kind") == "file").alias("files"))
    return out.crossJoin(F.broadcast(orphans.agg(F.count("*").alias("orphans"))))  # one row each
