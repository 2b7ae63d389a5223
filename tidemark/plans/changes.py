"""Queries of set operations, ranges and mutations (survey groups J and 2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import changelog, intervals, layout, mutate, transact
from tidemark.plans.registry import query

c = F.col


@query("j1_new_and_retired", "SELECT a AS segment, 'new' AS what FROM (SELECT DISTINCT counter_b AS a FROM seam_event EXCEPT SELECT DISTINCT counter_a FROM seam_event) UNION ALL SELECT a, 'kept' FROM (SELECT DISTINCT counter_b AS a FROM seam_event INTERSECT SELECT DISTINCT counter_a FROM seam_event)")
def j1(t):
    now, seen = t.seam_event.select(c("counter_b").alias("segment")).distinct(), t.seam_event.select(c("counter_a").alias("segment")).distinct()
    return now.exceptAll(seen).withColumn("what", F.lit("new")).unionAll(now.intersect(seen).withColumn("what", F.lit("kept")))


@query("j2_lost_values", "SELECT value FROM (SELECT value, arg_max(type, seq) AS k, arg_max(f, seq) AS f FROM history WHERE type <> 'fail' GROUP BY value) WHERE k = 'ok' AND f = 'add' EXCEPT SELECT value FROM final_read")
def j2(t):
    return changelog.set_audit(t.history, t.final_read).where("verdict = 'lost'").select("value")


_GONE = "SELECT DISTINCT inode, owner, CAST(inode * 37 + owner * 11 AS BIGINT) AS g_start, CAST(CASE WHEN owner = 3 THEN 0 ELSE 1500 END AS BIGINT) AS g_length FROM lock WHERE owner < 5"
_OPEN = 4611686018427387903


_UNLOCKED = f"""WITH h AS (SELECT l.*, CASE WHEN l.length = 0 THEN {_OPEN} ELSE l.start + l.length END AS stop, g_start, CASE WHEN g_length = 0 THEN {_OPEN} ELSE g_start + g_length END AS g_stop FROM lock l LEFT JOIN ({_GONE}) g USING (inode, owner)),
  p AS (SELECT inode, owner, kind, start, stop FROM h WHERE g_start IS NULL OR start >= g_stop OR g_start >= stop UNION ALL SELECT inode, owner, kind, start, least(stop, g_start) FROM h WHERE g_start IS NOT NULL AND NOT (start >= g_stop OR g_start >= stop) AND start < g_start
  UNION ALL SELECT inode, owner, kind, greatest(start, g_stop), stop FROM h WHERE g_start IS NOT NULL AND NOT (start >= g_stop OR g_start >= stop) AND g_stop < stop) SELECT inode, owner, kind, start, CASE WHEN stop = {_OPEN} THEN 0 ELSE stop - start END AS length FROM p"""


@query("j3_subtract_ranges", _UNLOCKED)
def j3(t):
    gone = t.lock.where("owner < 5").select("inode", "owner", (c("inode") * 37 + c("owner") * 11).alias("start"), F.when(c("owner") == 3, 0).otherwise(1500).cast("long").alias("length")).distinct()
    return intervals.unlock(t.lock, gone)


@query("j8_relock", _UNLOCKED + f" UNION ALL SELECT inode, owner, 'write', g_start, g_length FROM ({_GONE})")
def j8(t):
    wanted = t.lock.where("owner < 5").select("inode", "owner", F.lit("write").alias("kind"), (c("inode") * 37 + c("owner") * 11).alias("start"), F.when(c("owner") == 3, 0).otherwise(1500).cast("long").alias("length")).distinct()
    return intervals.relock(t.lock, wanted)


@query("j4_release_sessions", "SELECT * FROM lock WHERE owner NOT IN (SELECT s_suppkey % 7 FROM supplier WHERE s_suppkey < 3)")
def j4(t):
    owners = t.supplier.where("s_suppkey < 3").select((c("s_suppkey") % 7).alias("owner"))
    return intervals.release(t.lock, owners)


@query("j5_distinct_names", "SELECT epoch, counter, CAST(count(DISTINCT inode * 100 + extent) AS BIGINT) AS names FROM frame GROUP BY epoch, counter")
def j5(t):
    return t.frame.select("epoch", "counter", "inode", "extent").distinct().groupBy("epoch", "counter").agg(F.count("*").alias("names"))


@query("j6_union_of_selections", "SELECT epoch, counter, min(pass) AS pass FROM (SELECT epoch, counter, 0 AS pass FROM segcount WHERE counter % 11 = 0 UNION ALL SELECT epoch, counter, 1 FROM segcount WHERE live = 0 UNION ALL SELECT epoch, counter, 2 FROM segcount WHERE live * 2 < total) GROUP BY epoch, counter")
def j6(t):
    parts = [t.segcount.where(w).select("epoch", "counter", F.lit(k).alias("pass")) for k, w in enumerate(("counter % 11 = 0", "live = 0", "live * 2 < total"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("epoch", "counter").agg(F.min("pass").alias("pass"))


_CUT = "SELECT inode_id AS inode, size // 2 AS new_size FROM inode WHERE kind = 'file' AND inode_id % 5 = 0"


@query("j7_truncate", f"SELECT x.epoch, x.counter, CAST(-sum(x.byte_len) AS BIGINT) AS d_live FROM extent x JOIN ({_CUT}) k ON k.inode = x.inode WHERE x.extent >= (k.new_size + 32767) // 32768 GROUP BY x.epoch, x.counter")
def j7(t):
    sizes = t.inode.where("kind = 'file' and inode_id % 5 = 0").select(c("inode_id").alias("inode"), F.expr("size div 2").alias("new_size"))
    return layout.truncate(t.extent, sizes)[1]


@query("k7_tombstone_shrink", "SELECT inode_id, remaining_size, greatest((remaining_size + 32767) // 32768 - 4, 0) * 32768 AS remaining_after FROM tombstone")
def k7(t):
    return mutate.shrink_tombstones(t.tombstone, 4)


@query("k8_replay_decision", "SELECT seqno, op_index, CASE WHEN key % 11 = 0 THEN 'nothing' WHEN key % 3 < epoch THEN 'discard_stale' WHEN value % 2 = 0 AND key % 3 = epoch THEN 'discard_solo' ELSE 'replay' END AS decision FROM change")
def k8(t):
    tail = F.when(c("key") % 11 != 0, c("key") % 3)
    return t.change.select("seqno", "op_index", changelog.replay_decision(c("epoch"), tail, c("value") % 2 == 0).alias("decision"))


@query("k9_replay_tail", "SELECT seqno, op_index, op, key, value FROM change WHERE seqno > 14000 ORDER BY seqno, op_index")
def k9(t):
    return changelog.replay(t.change, 14_000).select("seqno", "op_index", "op", "key", "value")


_SIZES = "SELECT inode, max(\"offset\" + length) AS new_size FROM access WHERE operation = 'write' GROUP BY inode"


@query("m1_create", "SELECT 1000000 + event_id % 1500 AS dir_id, concat('new-', CAST(event_id AS STRING)) AS name, 20000000000 + event_id AS inode_id, CAST(coalesce(m.top, 2) + row_number() OVER (PARTITION BY event_id % 1500 ORDER BY event_id) AS BIGINT) AS cookie FROM access LEFT JOIN (SELECT dir_id, max(cookie) AS top FROM dir_entry GROUP BY dir_id) m ON m.dir_id = 1000000 + event_id % 1500 WHERE operation = 'create'")
def m1(t):
    new = t.access.where("operation = 'create'").select((1_000_000 + c("event_id") % 1500).alias("dir_id"), F.concat(F.lit("new-"), c("event_id").cast("string")).alias("name"), (20_000_000_000 + c("event_id")).alias("inode_id"))
    return mutate.create(t.dir_entry, new)


@query("m2_write_sizes", f"SELECT i.inode_id, greatest(i.size, w.new_size) AS size, greatest(i.size, w.new_size) - i.size AS growth FROM inode i JOIN ({_SIZES}) w ON w.inode = i.inode_id WHERE i.kind = 'file'")
def m2(t):
    return mutate.write_sizes(t.inode, t.access.where("operation = 'write'"))


@query("m3_read_clamped", "SELECT a.event_id, greatest(least(a.\"offset\" + a.length, i.size) - a.\"offset\", 0) AS bytes, a.\"offset\" + a.length >= i.size AS eof FROM access a JOIN inode i ON i.inode_id = a.inode WHERE a.operation = 'read' AND i.kind = 'file'")
def m3(t):
    return mutate.read_clamped(t.inode, t.access.where("operation = 'read'"))


@query("m4_trim", "SELECT inode, CAST(count(*) AS BIGINT) AS dropped, CAST(sum(byte_len) AS BIGINT) AS bytes FROM (SELECT DISTINCT x.* FROM extent x JOIN (SELECT inode, \"offset\" AS start, length * 60 AS length FROM access WHERE event_id % 4 = 1) a ON a.inode = x.inode AND x.extent * 32768 >= a.start AND (x.extent + 1) * 32768 <= a.start + a.length) GROUP BY inode")
def m4(t):
    return mutate.trim(t.extent, t.access.where("event_id % 4 = 1").withColumn("length", c("length") * 60))


@query("m5_link", "SELECT i.inode_id, i.nlink + k.n AS nlink, CAST(NULL AS BIGINT) AS parent FROM inode i JOIN (SELECT inode, CAST(count(DISTINCT user_id) AS BIGINT) AS n FROM access WHERE operation = 'lookup' GROUP BY inode) k ON k.inode = i.inode_id WHERE i.kind <> 'directory'")
def m5(t):
    new = t.access.where("operation = 'lookup'").select(c("inode").alias("inode_id"), c("user_id").alias("dir_id")).distinct()
    return mutate.link(t.inode, new)


@query("m6_remove", "SELECT i.inode_id, CASE WHEN i.nlink > 1 THEN 'unlinked' WHEN i.inode_id % 4 = 0 THEN 'orphan' WHEN i.kind = 'file' AND i.size > 0 THEN 'tombstone' ELSE 'gone' END AS fate FROM inode i WHERE i.kind <> 'directory' AND i.inode_id IN (SELECT inode FROM access WHERE operation = 'remove')")
def m6(t):
    return mutate.remove(t.inode, t.access.where("operation = 'remove'").select(c("inode").alias("inode_id")), c("inode_id") % 4 == 0)


@query("m7_rename", "SELECT e.dir_id AS from_dir, e.inode_id, CASE WHEN e.inode_id > 1000000 THEN 100 + e.inode_id % 25 ELSE 1 + e.inode_id % 5 END AS to_dir FROM dir_entry e WHERE e.inode_id BETWEEN 100 AND 9999999999 AND e.inode_id % 3 = 0")
def m7(t):
    moves = t.dir_entry.where("inode_id between 100 and 9999999999 and inode_id % 3 = 0").select("dir_id", "inode_id", F.when(c("inode_id") > 1_000_000, 100 + c("inode_id") % 25).otherwise(1 + c("inode_id") % 5).alias("to_dir"))
    return mutate.rename(t.inode, moves)


@query("m8_orphan_reclaim", "SELECT o.inode_id, coalesce(i.size, 0) AS bytes FROM orphan o LEFT JOIN inode i ON i.inode_id = o.inode_id WHERE o.inode_id % 2 = 0")
def m8(t):
    return mutate.reclaim_orphans(t.orphan.where("inode_id % 2 = 0"), t.inode)


def _tables(t):
    return {name: getattr(t, name) for name in transact.KEYS}


def _counts(ctes: str, **counted: str) -> str:
    """SQL of the rows that a batch puts (``table``) and deletes (``no_table``)."""
    rows = " UNION ALL ".join(f"""SELECT '{k.removeprefix("no_")}' AS "table", '{"delete" if k.startswith("no_") else "put"}' AS op, count(*) AS rows FROM {v}""" for k, v in counted.items())
    return f"WITH {ctes} {rows}"


_FREE = "FROM n JOIN inode i ON i.inode_id = n.dir_id AND i.kind = 'directory' WHERE NOT EXISTS (SELECT 1 FROM dir_entry e WHERE e.dir_id = n.dir_id AND e.name = n.name)"
_NEW = "n AS (SELECT 1000000 + event_id % 1500 AS dir_id, concat('new-', CAST(event_id AS STRING)) AS name, 20000000000 + event_id AS inode_id FROM access WHERE operation = 'create')"


@query("m9_create_changes", _counts(f"{_NEW}, p AS (SELECT n.* {_FREE})", dir_entry="p", dir_scan="p", dir_cookie="(SELECT DISTINCT dir_id FROM p)", inode="(SELECT inode_id FROM p UNION SELECT dir_id FROM p)", stats_shard="(SELECT DISTINCT inode_id % 100 FROM p)"))
def m9(t):
    kind = F.when(c("event_id") % 3 == 0, "file").when(c("event_id") % 3 == 1, "directory").otherwise("symlink")
    new = t.access.where("operation = 'create'").select(
        (1_000_000 + c("event_id") % 1500).alias("dir_id"), F.concat(F.lit("new-"), c("event_id").cast("string")).alias("name"), (20_000_000_000 + c("event_id")).alias("inode_id"), kind.alias("kind"), F.when(kind == "symlink", 9).otherwise(0).cast("long").alias("size"),
        F.lit(420).cast("long").alias("mode"), (c("user_id") % 7).alias("uid"), (c("user_id") % 5).alias("gid"),
    )
    return transact.create(_tables(t), new, 0).summary()


_LN = "n AS (SELECT DISTINCT 1000000 + user_id % 150 AS dir_id, concat('ln-', CAST(event_id AS STRING)) AS name, inode AS inode_id FROM access WHERE operation = 'lookup')"


@query(
    "m10_link_changes",
    _counts(
        f"{_LN}, p AS (SELECT n.* {_FREE} AND EXISTS (SELECT 1 FROM inode f WHERE f.inode_id = n.inode_id AND f.kind <> 'directory' AND f.nlink > 0))", dir_entry="p",
        dir_scan="(SELECT dir_id, name FROM p UNION ALL SELECT dir_id, name FROM dir_scan WHERE e_size IS NOT NULL AND inode_id IN (SELECT inode_id FROM p))", dir_cookie="(SELECT DISTINCT dir_id FROM p)", inode="(SELECT inode_id FROM p UNION SELECT dir_id FROM p)",
    ),
)
def m10(t):
    new = t.access.where("operation = 'lookup'").select((1_000_000 + c("user_id") % 150).alias("dir_id"), F.concat(F.lit("ln-"), c("event_id").cast("string")).alias("name"), c("inode").alias("inode_id"))
    return transact.link(_tables(t), new).summary()


_GONE_NAMES = "g AS (SELECT e.*, i.kind, i.size, i.nlink FROM dir_entry e JOIN inode i ON i.inode_id = e.inode_id WHERE e.inode_id % 7 = 3 AND (i.kind <> 'directory' OR NOT EXISTS (SELECT 1 FROM dir_entry x WHERE x.dir_id = e.inode_id)))"
_FATES = "f AS (SELECT inode_id, kind, size, CASE WHEN kind <> 'directory' AND count(*) < nlink THEN 'named' WHEN inode_id % 4 = 0 THEN 'orphan' ELSE 'gone' END AS fate FROM g GROUP BY inode_id, kind, size, nlink)"


@query(
    "m11_remove_changes",
    _counts(
        f"{_GONE_NAMES}, {_FATES}, above AS (SELECT DISTINCT dir_id AS inode_id FROM g WHERE dir_id IN (SELECT inode_id FROM inode WHERE kind = 'directory') AND dir_id NOT IN (SELECT inode_id FROM f WHERE fate = 'gone'))",
        inode="(SELECT inode_id FROM above UNION ALL SELECT inode_id FROM f WHERE fate <> 'gone')", stats_shard="(SELECT DISTINCT inode_id % 100 FROM f WHERE fate = 'gone')", tombstone="(SELECT 1 FROM f WHERE fate = 'gone' AND kind = 'file' AND size > 0)",
        orphan="(SELECT 1 FROM f WHERE fate = 'orphan')", no_dir_entry="g", no_dir_scan="g", no_inode="(SELECT 1 FROM f WHERE fate = 'gone')", no_dir_cookie="(SELECT 1 FROM f WHERE fate = 'gone' AND kind = 'directory')",
    ),
)
def m11(t):
    return transact.remove(_tables(t), t.dir_entry.where("inode_id % 7 = 3"), t.inode.where("inode_id % 4 = 0"), 0).summary()


_MOVES = "n AS (SELECT e.dir_id AS from_dir, 100 + e.inode_id % 25 AS dir_id, concat(e.name, '-m') AS name, e.inode_id FROM dir_entry e JOIN inode o ON o.inode_id = e.inode_id WHERE e.inode_id BETWEEN 1000000 AND 9999999999)"


@query(
    "m12_rename_changes",
    _counts(
        f"{_MOVES}, p AS (SELECT n.* {_FREE})", dir_entry="p", dir_scan="p", dir_cookie="(SELECT DISTINCT dir_id FROM p)",
        inode="(SELECT inode_id FROM p UNION SELECT dir_id FROM p UNION SELECT from_dir FROM p WHERE from_dir IN (SELECT inode_id FROM inode WHERE kind = 'directory'))", no_dir_entry="p", no_dir_scan="p",
    ),
)
def m12(t):
    moves = t.dir_entry.where("inode_id between 1000000 and 9999999999").select("dir_id", "name", (100 + c("inode_id") % 25).alias("to_dir"), F.concat("name", F.lit("-m")).alias("to_name"))
    return transact.rename(_tables(t), moves).summary()


@query("m13_set_attributes", """SELECT inode_id, CASE WHEN who <> 0 AND to_gid IS NOT NULL AND kind <> 'directory' THEN m & 1023 ELSE m END AS mode, coalesce(to_uid, uid) AS uid, coalesce(to_gid, gid) AS gid FROM (
  SELECT *, inode_id % 4 AS who, CASE WHEN inode_id % 3 = 0 THEN 420 ELSE mode END AS m, CASE WHEN inode_id % 8 = 4 THEN 1 END AS to_uid, CASE WHEN inode_id % 3 = 1 THEN 2 END AS to_gid FROM inode) WHERE (who = 0 OR who = uid) AND (who = 0 OR to_uid IS NULL OR to_uid = uid)""")
def m13(t):
    asked = t.inode.select("inode_id", (c("inode_id") % 4).alias("who"), F.when(c("inode_id") % 3 == 0, F.lit(420)).cast("long").alias("mode"), F.when(c("inode_id") % 8 == 4, F.lit(1)).cast("long").alias("uid"), F.when(c("inode_id") % 3 == 1, F.lit(2)).cast("long").alias("gid"))
    return transact.set_attributes(_tables(t), asked).put["inode"].select("inode_id", "mode", "uid", "gid")
