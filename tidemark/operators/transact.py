"""Batches of namespace operations as changes of every table that they touch.

``Tables`` holds the seven tables of a namespace by name; an operation gives ``Changes``: for each table the
rows that it puts (by the table's key, whole rows) and the keys that it deletes.  ``apply`` gives the tables
after that.  A batch names an entry or an object once; asks that cannot be met (no such directory, a name
that is taken, a directory that is not empty, a move below oneself) change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.namespace import is_ancestor

c = F.col
KEYS = {"inode": ["inode_id"], "dir_entry": ["dir_id", "name"], "dir_scan": ["dir_id", "cookie"], "dir_cookie": ["dir_id"], "stats_shard": ["shard_id"], "tombstone": ["ts", "inode_id"], "orphan": ["inode_id"]}
Tables = dict[str, DataFrame]


@dataclass
class Changes:
    """put: whole rows by table; gone: keys by table."""

    put: Tables = field(default_factory=dict)
    gone: Tables = field(default_factory=dict)

    def summary(self) -> DataFrame:
        """(table, op, rows): how many rows of each table are put and deleted."""
        parts = [x.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.lit(op).alias("op"), "rows") for op, some in (("put", self.put), ("delete", self.gone)) for name, x in some.items()]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionAll(x)
        return out


def apply(tables: Tables, changes: Changes) -> Tables:
    """The tables after a batch: its deletes, then its puts."""
    out = dict(tables)
    for name, key in KEYS.items():
        rows = out[name]
        for some in (changes.gone, changes.put):
            if name in some:
                rows = rows.join(some[name].select(*key), key, "left_anti").select(*tables[name].columns)
        out[name] = rows.unionByName(changes.put[name].select(*rows.columns)) if name in changes.put else rows
    return out


def _directories(tables: Tables) -> DataFrame:
    return tables["inode"].where("kind = 'directory'")


def _placed(tables: Tables, new: DataFrame) -> DataFrame:
    """New names (dir_id, name, inode_id, ...) that can be made, with the cookies that follow those of their directories."""
    there = new.join(_directories(tables).select(c("inode_id").alias("dir_id")), "dir_id", "left_semi").join(tables["dir_entry"].select("dir_id", "name"), ["dir_id", "name"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("dir_id").orderBy("inode_id", "name"))
    return there.join(tables["dir_cookie"], "dir_id", "left").withColumn("cookie", (F.coalesce("next_cookie", F.lit(3)) + rank - 1).cast("long")).drop("next_cookie")


def _cookies(placed: DataFrame) -> DataFrame:
    return placed.groupBy("dir_id").agg((F.max("cookie") + 1).alias("next_cookie"))


def _scan(placed: DataFrame, embedded: Column) -> DataFrame:
    """Listing rows: with the object's attributes where it has one name and is no directory."""
    own = [F.when(embedded, c(k)).cast("long").alias(f"e_{k}") for k in ("size", "mode", "uid")]
    return placed.select("dir_id", "cookie", "name", "inode_id", *own)


def _parents(tables: Tables, deltas: DataFrame) -> DataFrame:
    """Directory inodes after (dir_id, entries, subdirs) have been added up."""
    total = deltas.groupBy(c("dir_id").alias("inode_id")).agg(F.sum("entries").alias("d_entries"), F.sum("subdirs").alias("d_subdirs"))
    rows = _directories(tables).join(total, "inode_id")
    return rows.withColumn("entry_count", c("entry_count") + c("d_entries")).withColumn("nlink", c("nlink") + c("d_subdirs")).select(*tables["inode"].columns)


def _usage(tables: Tables, deltas: DataFrame) -> DataFrame:
    """Usage shards after (inode_id, bytes, inodes) have been added up."""
    total = deltas.groupBy((c("inode_id") % 100).alias("shard_id")).agg(F.sum("bytes").alias("d_bytes"), F.sum("inodes").alias("d_inodes"))
    rows = total.join(tables["stats_shard"], "shard_id", "left")
    add = lambda k, d: (F.coalesce(k, F.lit(0).cast("long")) + c(d)).cast("long").alias(k)
    return rows.select("shard_id", add("used_bytes", "d_bytes"), add("used_inodes", "d_inodes"))


def _subdir(kind: str = "kind") -> Column:
    return (c(kind) == "directory").cast("long")


def create(tables: Tables, new: DataFrame, now: int) -> Changes:
    """Files, directories, links and nodes: new has dir_id, name, inode_id, kind, size (of a symlink's target), mode, uid, gid."""
    placed = _placed(tables, new)
    made = placed.select(
        "inode_id", "kind", "size", "mode", "uid", "gid", (1 + _subdir()).alias("nlink"), c("dir_id").alias("parent"), "name",
        F.when(c("kind") == "directory", F.lit(0).cast("long")).alias("entry_count"), F.lit(now).cast("long").alias("mtime"),
    )
    above = _parents(tables, placed.select("dir_id", F.lit(1).cast("long").alias("entries"), _subdir().alias("subdirs")))
    usage = _usage(tables, placed.select("inode_id", F.when(c("kind") == "file", c("size")).otherwise(0).alias("bytes"), F.lit(1).alias("inodes")))
    return Changes({"dir_entry": placed.select("dir_id", "name", "inode_id", "cookie"), "dir_scan": _scan(placed, c("kind") != "directory"), "dir_cookie": _cookies(placed), "inode": above.unionByName(made), "stats_shard": usage})


def link(tables: Tables, new: DataFrame) -> Changes:
    """Further names (dir_id, name, inode_id) of objects that are no directories; they lose their parent, and listings only refer to them."""
    files = tables["inode"].where("kind <> 'directory' and nlink > 0")
    placed = _placed(tables, new.join(files.select("inode_id"), "inode_id", "left_semi"))
    more = placed.groupBy("inode_id").agg(F.count("*").alias("n"))
    linked = files.join(more, "inode_id").withColumn("nlink", c("nlink") + c("n")).withColumn("parent", F.lit(None).cast("long")).withColumn("name", F.lit(None).cast("string")).select(*files.columns)
    above = _parents(tables, placed.select("dir_id", F.lit(1).cast("long").alias("entries"), F.lit(0).cast("long").alias("subdirs")))
    old = tables["dir_scan"].join(more.select("inode_id"), "inode_id", "left_semi").where("e_size is not null")
    plain = [F.lit(None).cast("long").alias(f"e_{k}") for k in ("size", "mode", "uid")]
    refer = old.select("dir_id", "cookie", "name", "inode_id", *plain).unionByName(placed.select("dir_id", "cookie", "name", "inode_id", *plain))
    return Changes({"dir_entry": placed.select("dir_id", "name", "inode_id", "cookie"), "dir_scan": refer, "dir_cookie": _cookies(placed), "inode": above.unionByName(linked)})


def remove(tables: Tables, names: DataFrame, opened: DataFrame, now: int) -> Changes:
    """Names (dir_id, name) that go, and objects with their last one.

    Directories have to be empty.  Objects that are open (``opened``: inode_id) become orphans and keep their
    usage; of others with data a tombstone stays.
    """
    asked = names.select("dir_id", "name").distinct().join(tables["dir_entry"], ["dir_id", "name"])
    objects = tables["inode"].select("inode_id", "kind", "size", "nlink")
    full = tables["dir_entry"].select(c("dir_id").alias("inode_id")).distinct().withColumn("full", F.lit(True))
    gone = asked.join(objects, "inode_id").join(full, "inode_id", "left").where("kind <> 'directory' or full is null").drop("full")
    each = gone.groupBy("inode_id", "kind", "size", "nlink").agg(F.count("*").alias("n")).join(opened.select("inode_id").distinct().withColumn("open", F.lit(True)), "inode_id", "left")
    last = (c("kind") == "directory") | (c("n") >= c("nlink"))
    fate = F.when(~last, "named").when(c("open"), "orphan").otherwise("gone")
    each = each.withColumn("fate", fate)
    ends = each.where("fate = 'gone'")
    left = tables["inode"].join(each.where("fate <> 'gone'").select("inode_id", "n", "fate"), "inode_id")
    left = left.withColumn("nlink", F.when(c("fate") == "orphan", F.lit(0).cast("long")).otherwise(c("nlink") - c("n"))).select(*tables["inode"].columns)
    staying = gone.join(ends.select(c("inode_id").alias("dir_id")), "dir_id", "left_anti")
    above = _parents(tables, staying.select("dir_id", F.lit(-1).cast("long").alias("entries"), (-_subdir()).alias("subdirs")))
    usage = _usage(tables, ends.select("inode_id", F.when(c("kind") == "file", -c("size")).otherwise(0).alias("bytes"), F.lit(-1).alias("inodes")))
    stones = ends.where("kind = 'file' and size > 0").select(F.lit(now).cast("long").alias("ts"), "inode_id", c("size").alias("remaining_size"))
    return Changes(
        {"inode": above.unionByName(left), "stats_shard": usage, "tombstone": stones, "orphan": each.where("fate = 'orphan'").select("inode_id")},
        {"dir_entry": gone.select("dir_id", "name"), "dir_scan": gone.select("dir_id", "cookie"), "inode": ends.select("inode_id"), "dir_cookie": ends.where("kind = 'directory'").select(c("inode_id").alias("dir_id"))},
    )


def rename(tables: Tables, moves: DataFrame) -> Changes:
    """Names (dir_id, name) that become (to_dir, to_name); a name that is taken, or a place below the object itself, refuses the move."""
    objects = tables["inode"].select("inode_id", "kind", "size", "mode", "uid", "nlink")
    asked = moves.join(tables["dir_entry"].withColumnRenamed("cookie", "old_cookie"), ["dir_id", "name"]).join(objects, "inode_id")
    loops = is_ancestor(tables["inode"], asked.where("kind = 'directory'").select(c("inode_id").alias("ancestor"), c("to_dir").alias("inode_id"))).where("yes")
    asked = asked.join(loops.select(c("ancestor").alias("inode_id"), c("inode_id").alias("to_dir")), ["inode_id", "to_dir"], "left_anti")
    placed = _placed(tables, asked.withColumnRenamed("dir_id", "from_dir").withColumnRenamed("name", "from_name").withColumnRenamed("to_dir", "dir_id").withColumnRenamed("to_name", "name"))
    one = F.lit(1).cast("long")
    above = _parents(tables, placed.select("dir_id", one.alias("entries"), _subdir().alias("subdirs")).unionAll(placed.select("from_dir", -one, -_subdir())))
    single = placed.where("kind = 'directory' or nlink = 1").select("inode_id", c("dir_id").alias("to_dir"), c("name").alias("to_name"))
    # a directory may be moved and be the place of another move
    after = tables["inode"].join(above.select("inode_id", c("entry_count").alias("e"), c("nlink").alias("l")), "inode_id", "left").join(single, "inode_id", "left").where("e is not null or to_dir is not null")
    after = after.withColumn("entry_count", F.coalesce("e", "entry_count")).withColumn("nlink", F.coalesce("l", "nlink")).withColumn("parent", F.coalesce("to_dir", "parent")).withColumn("name", F.coalesce("to_name", "name"))
    scan = _scan(placed, (c("kind") != "directory") & (c("nlink") == 1))
    return Changes(
        {"dir_entry": placed.select("dir_id", "name", "inode_id", "cookie"), "dir_scan": scan, "dir_cookie": _cookies(placed), "inode": after.select(*tables["inode"].columns)},
        {"dir_entry": placed.select(c("from_dir").alias("dir_id"), c("from_name").alias("name")), "dir_scan": placed.select(c("from_dir").alias("dir_id"), c("old_cookie").alias("cookie"))},
    )


def set_attributes(tables: Tables, asked: DataFrame) -> Changes:
    """Modes and owners: asked has inode_id, who, mode, uid, gid (null: unchanged).

    Only the owner or user 0 sets a mode or a group, only user 0 an owner; for others than user 0 a change of owner or
    group clears the set-id bits.  Listings that embed the object follow.
    """
    rows = tables["inode"].join(asked.select("inode_id", "who", c("mode").alias("to_mode"), c("uid").alias("to_uid"), c("gid").alias("to_gid")), "inode_id")
    root, owner = c("who") == 0, (c("who") == 0) | (c("who") == c("uid"))
    rows = rows.where(owner & (root | c("to_uid").isNull() | (c("to_uid") == c("uid"))))
    mode = F.coalesce(c("to_mode").bitwiseAND(4095), c("mode"))
    moved = ~root & (c("to_uid").isNotNull() | c("to_gid").isNotNull()) & (c("kind") != "directory")
    rows = rows.withColumn("mode", F.when(moved, mode.bitwiseAND(1023)).otherwise(mode).cast("long")).withColumn("uid", F.coalesce("to_uid", "uid")).withColumn("gid", F.coalesce("to_gid", "gid"))
    after = rows.select(*tables["inode"].columns)
    own = after.select("inode_id", *[c(k).alias(f"n_{k}") for k in ("size", "mode", "uid")])
    scan = tables["dir_scan"].where("e_size is not null").join(own, "inode_id").select("dir_id", "cookie", "name", "inode_id", *[c(f"n_{k}").alias(f"e_{k}") for k in ("size", "mode", "uid")])
    return Changes({"inode": after, "dir_scan": scan})
