"""The directory tree: listings, lookups, paths, walks, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.sinks import kept

c = F.col


def listing(scan: DataFrame, inodes: DataFrame) -> DataFrame:
    """Entries with attributes: the embedded copy where there is one, else the inode's; entries of vanished inodes are left out."""
    own = inodes.select("inode_id", c("size").alias("i_size"), c("mode").alias("i_mode"))
    rows = scan.join(own, "inode_id", "left")
    return rows.select("dir_id", "cookie", "name", "inode_id", F.coalesce("e_size", "i_size").alias("size"), F.coalesce("e_mode", "i_mode").alias("mode")).where("size is not null")


def lookup(entries: DataFrame, inodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Entries by name, and by directory if that is given, with the target's and the directory's attributes."""
    by = [k for k in ("dir_id", "name") if k in asked.columns]
    hit = entries.join(asked.select(*by).distinct(), by)
    target = inodes.select("inode_id", "kind", "size")
    parent = inodes.select(c("inode_id").alias("dir_id"), c("mode").alias("dir_mode"))
    return hit.join(target, "inode_id").join(parent, "dir_id").select("dir_id", "name", "inode_id", "kind", "size", "dir_mode")


def _jumps(steps: DataFrame) -> list[DataFrame]:
    """From (n, a), one step up: the steps of 1, 2, 4 and so on, as long as there are any.

    A way without cycles is shorter than the number of steps; what goes on beyond that is on a cycle
    or leads to one, and is taken out.
    """
    jump = kept(steps.select("n", "a"))
    most, out = jump.count(), []
    while jump.limit(1).count():
        if 1 << len(out) > most:
            endless = kept(jump.select("n").distinct())
            return [kept(x.join(endless, "n", "left_anti")) for x in out]
        out.append(jump)
        jump = kept(jump.select("n", c("a").alias("m")).join(jump.select(c("n").alias("m"), "a"), "m").select("n", "a"))
    return out


def chains(inodes: DataFrame) -> DataFrame:
    """(inode_id, at, depth): every object with itself and all its ancestors up to the root.

    Ancestors are found in steps that double; objects without a parent end their chain, and objects on
    or below a cycle have no ancestors.
    """
    up = inodes.where("inode_id <> 0 and parent is not null").select(c("inode_id").alias("n"), c("parent").alias("a"))
    own = inodes.select("inode_id").unionAll(inodes.where("parent is not null").select("parent")).distinct()
    known = own.select(c("inode_id").alias("n"), c("inode_id").alias("at"), F.lit(0).alias("depth"))
    for k, jump in enumerate(_jumps(up)):
        above = known.select(c("n").alias("a"), "at", (c("depth") + (1 << k)).alias("depth"))
        known = kept(known.unionAll(jump.join(above, "a").select("n", "at", "depth")))
    return known.withColumnRenamed("n", "inode_id").join(inodes.select("inode_id"), "inode_id", "left_semi").select("inode_id", "at", "depth")


def paths(inodes: DataFrame) -> DataFrame:
    """(inode_id, path): names joined from the root; "/" for the root, "<inode:N>" for objects with several parents.

    Directories, a small part of all objects, get their paths in steps that double: each has the names
    up to some ancestor and takes over that one's.  Files then need one join with their directory.
    Directories that the root does not hold count as if they stood in it.
    """
    dirs = inodes.where("kind = 'directory' and inode_id <> 0 and parent is not null")
    way = kept(dirs.select(c("inode_id").alias("n"), c("parent").alias("a"), F.concat(F.lit("/"), "name").alias("path")))
    left = way.where("a <> 0").count()
    while left:
        above = way.select(c("n").alias("a"), c("a").alias("top"), c("path").alias("above"))
        step = way.where("a <> 0").join(above, "a").select("n", c("top").alias("a"), F.concat("above", "path").alias("path"))
        way = kept(way.where("a = 0").unionAll(step))
        left, before = way.where("a <> 0").count(), left
        if left == before:  # a cycle
            break
    above = way.where("a = 0").select(c("n").alias("parent"), c("path").alias("above"))
    rows = inodes.select("inode_id", "parent", "name").join(above, "parent", "left")
    orphaned = F.concat(F.lit("<inode:"), c("inode_id").cast("string"), F.lit(">"))
    return rows.select("inode_id", F.when(c("inode_id") == 0, "/").when(c("parent").isNull(), orphaned).otherwise(F.concat(F.coalesce("above", F.lit("")), F.lit("/"), c("name"))).alias("path"))


def is_ancestor(inodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ancestor, inode_id, yes): whether one object is above another or the same.

    Only the chains of directories are made; an object is looked up by its parent.
    """
    known = inodes.select("inode_id", c("parent").alias("up"), F.lit(True).alias("there"))
    asked = pairs.select("ancestor", "inode_id").distinct().join(known, "inode_id", "left")
    above = chains(inodes.where("kind = 'directory'")).select(c("inode_id").alias("up"), c("at").alias("ancestor"), F.lit(True).alias("found")).distinct()
    rows = asked.join(above, ["up", "ancestor"], "left")
    yes = F.coalesce(c("there") & (c("inode_id") == c("ancestor")), F.lit(False)) | F.coalesce(c("found") & (c("inode_id") != 0), F.lit(False))
    return rows.select("ancestor", "inode_id", yes.alias("yes"))


def depths(entries: DataFrame) -> DataFrame:
    """(dir_id, depth): directories that the root holds, once for each way to them."""
    edges = entries.select("dir_id", "inode_id").where("inode_id <> 0")
    folders = edges.join(edges.select(c("dir_id").alias("inode_id")).distinct(), "inode_id", "left_semi")
    found = entries.sparkSession.range(1).select(c("id").alias("dir_id"), F.lit(0).alias("depth"))
    for k, jump in enumerate(_jumps(folders.select(c("inode_id").alias("n"), c("dir_id").alias("a")))):
        more = jump.join(found.withColumnRenamed("dir_id", "a"), "a").select(c("n").alias("dir_id"), (c("depth") + (1 << k)).alias("depth"))
        found = kept(found.unionAll(more))
    return found


def met(entries: DataFrame) -> DataFrame:
    """The entries that a walk from the root meets."""
    return entries.join(depths(entries).select("dir_id").distinct(), "dir_id", "left_semi").select(*entries.columns)


def walk(scan: DataFrame) -> DataFrame:
    """(inode_id, depth, name) of every entry reached from the root, once for each way."""
    return scan.select("dir_id", "name", "inode_id").join(depths(scan), "dir_id").select("inode_id", (c("depth") + 1).alias("depth"), "name")


def search(scan: DataFrame, pattern: Column, max_depth: int = 10, limit: int = 100) -> DataFrame:
    """The first hits of a name pattern, shallow ones first."""
    return walk(scan).where((c("depth") <= max_depth) & F.rlike("name", pattern)).orderBy("depth", "name", "inode_id").limit(limit)


def sorted_for_browser(entries: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Directories always first; the direction turns key and name."""
    turn = F.desc if descending else F.asc
    return entries.orderBy(F.desc("is_dir"), turn(key), turn("name"))
