"""Queries of joins (survey group E) and listings of the namespace (H8, H9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.attributes import query_pattern
from tidemark.operators import accounting, intervals, liveness, namespace
from tidemark.operators.changelog import set_audit
from tidemark.plans.registry import query

c = F.col


@query("e1_readdir", "SELECT s.dir_id, s.cookie, s.name, s.inode_id, coalesce(s.e_size, i.size) AS size, coalesce(s.e_mode, i.mode) AS mode FROM dir_scan s LEFT JOIN inode i ON i.inode_id = s.inode_id WHERE coalesce(s.e_size, i.size) IS NOT NULL")
def e1(t):
    return namespace.listing(t.dir_scan, t.inode)


@query("e2_lookup", "SELECT e.dir_id, e.name, e.inode_id, i.kind, i.size, p.mode AS dir_mode FROM dir_entry e JOIN inode i ON i.inode_id = e.inode_id JOIN inode p ON p.inode_id = e.dir_id WHERE e.name IN (SELECT concat('order-', CAST(event_id AS STRING)) FROM events WHERE event_id % 5 = 0)")
def e2(t):
    names = t.events.where("event_id % 5 = 0").select(F.concat(F.lit("order-"), c("event_id").cast("string")).alias("name"))
    return namespace.lookup(t.dir_entry, t.inode, names)


@query("e3_segment_verdicts", """SELECT f.epoch, f.counter, CASE WHEN max(CASE WHEN f.live OR f.kept THEN 1 ELSE 0 END) = 1 THEN 'keep' WHEN max(CASE WHEN o.epoch IS NOT NULL THEN 1 ELSE 0 END) = 0 THEN 'absent' ELSE 'reclaim' END AS verdict
  FROM (SELECT *, frame_index = 0 AND counter % 19 = 4 AS kept FROM frame_state) f LEFT JOIN segment_object o ON o.epoch = f.epoch AND o.counter = f.counter GROUP BY f.epoch, f.counter""")
def e3(t):
    durable = t.frame.where("frame_index = 0 and counter % 19 = 4")  # what the durable view still refers to
    return liveness.verdicts(t.frame, [t.extent, durable], t.segment_object)


@query("e4_gather_live", "SELECT inode, extent, epoch, counter, frame_index, byte_len FROM extent WHERE epoch * 10000 + counter IN (SELECT epoch * 10000 + counter FROM segcount WHERE live > 0 AND live * 4 < total)")
def e4(t):
    sources = t.segcount.where("live > 0 and live * 4 < total").withColumn("rank", c("epoch") * 10000 + c("counter"))
    return liveness.gather(t.frame, t.extent, sources)


@query("e5_orphan_objects", "SELECT o.epoch, o.counter, o.mtime, o.size FROM segment_object o WHERE o.mtime < 799500 AND NOT EXISTS (SELECT 1 FROM segcount s WHERE s.epoch = o.epoch AND s.counter = o.counter)")
def e5(t):
    return liveness.orphan_objects(t.segment_object, t.segcount, t.extent, 799_500).select("epoch", "counter", "mtime", "size")


@query("e6_dead_without_object", "SELECT s.epoch, s.counter, s.total FROM segcount s WHERE live = 0 AND NOT EXISTS (SELECT 1 FROM segment_object o WHERE o.epoch = s.epoch AND o.counter = s.counter)")
def e6(t):
    return liveness.dead_without_object(t.segcount, t.segment_object).select("epoch", "counter", "total")


@query("e7_read_ranges", """SELECT r.event_id, r.inode, r.extent, least((r.extent + 1) * 32768, r.start + r.length) - greatest(r.extent * 32768, r.start) AS wanted, x.epoch, x.counter, x.epoch IS NULL AS hole
  FROM (SELECT event_id, inode, "offset" AS start, length, unnest(range("offset" // 32768, ("offset" + length - 1) // 32768 + 1)) AS extent FROM access WHERE operation = 'read') r LEFT JOIN extent x ON x.inode = r.inode AND x.extent = r.extent""")
def e7(t):
    return liveness.read_ranges(t.access.where("operation = 'read'"), t.extent)


@query("e8_lock_conflicts", """SELECT h.inode, h.owner AS held_owner, h.kind AS held_kind, h.start AS held_start, h.length AS held_length, w.owner AS wanted_owner, w.kind AS wanted_kind, w.start AS wanted_start, w.length AS wanted_length
  FROM lock h JOIN lock w ON h.inode = w.inode AND h.owner <> w.owner AND NOT (h.kind = 'read' AND w.kind = 'read') AND h.start < CASE WHEN w.length = 0 THEN 4611686018427387903 ELSE w.start + w.length END AND w.start < CASE WHEN h.length = 0 THEN 4611686018427387903 ELSE h.start + h.length END
  WHERE h.start % 2 = 0 AND w.start % 2 = 1""")
def e8(t):
    return intervals.conflicts(t.lock.where("start % 2 = 0"), t.lock.where("start % 2 = 1"))


@query("e9_parent_chains", """WITH RECURSIVE chain AS (SELECT inode_id, inode_id AS at, 0 AS depth FROM inode WHERE kind = 'directory' UNION ALL SELECT k.inode_id, i.parent, k.depth + 1 FROM chain k JOIN inode i ON i.inode_id = k.at WHERE k.at <> 0 AND i.parent IS NOT NULL) SELECT * FROM chain""")
def e9(t):
    return namespace.chains(t.inode.where("kind = 'directory'"))


@query("e10_is_ancestor", """SELECT a AS ancestor, i.inode_id, CASE WHEN i.inode_id = a THEN true WHEN i.parent IS NULL THEN false ELSE i.parent = a OR coalesce(n.parent = a, false) OR coalesce(r.parent = a, false) OR a = 0 END AS yes
  FROM (SELECT *, CASE inode_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 100 + inode_id % 25 ELSE parent END AS a FROM inode WHERE inode_id > 1000000) i LEFT JOIN inode n ON n.inode_id = i.parent LEFT JOIN inode r ON r.inode_id = n.parent WHERE a IS NOT NULL""")
def e10(t):
    a = F.when(c("inode_id") % 3 == 0, F.lit(0).cast("long")).when(c("inode_id") % 3 == 1, 100 + c("inode_id") % 25).otherwise(c("parent"))
    pairs = t.inode.where("inode_id > 1000000").select(a.alias("ancestor"), "inode_id").where("ancestor is not null")
    return namespace.is_ancestor(t.inode, pairs)


@query("e11_tree_walk", """WITH RECURSIVE tree AS (SELECT dir_id, inode_id, 1 AS depth FROM dir_scan WHERE dir_id = 0 UNION ALL SELECT s.dir_id, s.inode_id, t.depth + 1 FROM tree t JOIN dir_scan s ON s.dir_id = t.inode_id) SELECT inode_id, CAST(min(depth) AS BIGINT) AS depth, CAST(count(*) AS BIGINT) AS refs FROM tree GROUP BY inode_id""")
def e11(t):
    return namespace.walk(t.dir_scan).groupBy("inode_id").agg(F.min("depth").cast("long").alias("depth"), F.count("*").alias("refs"))


@query("e12_name_search", """WITH RECURSIVE tree AS (SELECT dir_id, inode_id, name, 1 AS depth FROM dir_scan WHERE dir_id = 0 UNION ALL SELECT s.dir_id, s.inode_id, s.name, t.depth + 1 FROM tree t JOIN dir_scan s ON s.dir_id = t.inode_id) SELECT inode_id, depth, name FROM tree WHERE depth <= 10 AND regexp_matches(name, '(?i)^ORDER-.*77$') ORDER BY depth, name, inode_id LIMIT 100""")
def e12(t):
    return namespace.search(t.dir_scan, query_pattern(F.lit("ORDER-*77"))).select("inode_id", "depth", "name")


_PAIRS = "SELECT DISTINCT epoch AS epoch_a, counter AS counter_a, epoch AS epoch_b, counter + 7 AS counter_b FROM segcount WHERE counter % 5 = 0"


@query("e13_live_pairs", f"SELECT p.* FROM ({_PAIRS}) p WHERE EXISTS (SELECT 1 FROM segcount s WHERE s.epoch = epoch_a AND s.counter = counter_a AND s.live > 0) AND EXISTS (SELECT 1 FROM segcount s WHERE s.epoch = epoch_b AND s.counter = counter_b AND s.live > 0)")
def e13(t):
    pairs = t.segcount.where("counter % 5 = 0").select(c("epoch").alias("epoch_a"), c("counter").alias("counter_a"), c("epoch").alias("epoch_b"), (c("counter") + 7).alias("counter_b"))
    return liveness.live_pairs(pairs, t.segcount).select("epoch_a", "counter_a", "epoch_b", "counter_b")


@query("e14_reconcile_counters", """SELECT coalesce(k.epoch, r.epoch) AS epoch, coalesce(k.counter, r.counter) AS counter, k.live AS counted, r.referenced, CASE WHEN k.live IS NULL THEN 'missing_counter' WHEN coalesce(r.referenced, 0) <> k.live THEN 'wrong_live' ELSE 'live_over_total' END AS violation
  FROM (SELECT epoch, counter, live + CASE WHEN counter % 101 = 7 THEN 10 ELSE 0 END AS live, CASE WHEN counter % 103 = 9 THEN live - 1 ELSE total END AS total FROM segcount WHERE counter % 107 <> 11) k
  FULL JOIN (SELECT epoch, counter, CAST(sum(byte_len) AS BIGINT) AS referenced FROM extent GROUP BY epoch, counter) r ON r.epoch = k.epoch AND r.counter = k.counter WHERE k.live IS NULL OR coalesce(r.referenced, 0) <> k.live OR k.live > k.total""")
def e14(t):
    off = t.segcount.where("counter % 107 <> 11").select("epoch", "counter", (c("live") + F.when(c("counter") % 101 == 7, 10).otherwise(0)).alias("live"), F.when(c("counter") % 103 == 9, c("live") - 1).otherwise(c("total")).alias("total"))
    return accounting.reconcile(off, t.extent.groupBy("epoch", "counter").agg(F.sum("byte_len").alias("referenced")))


@query("e15_repoint", """WITH m AS (SELECT x.*, frame_index % 2 = 0 AS won FROM extent x WHERE x.epoch = 1998 AND counter % 10 < 3) SELECT epoch, counter, CAST(sum(d) AS BIGINT) AS d_live FROM (SELECT epoch, counter, -byte_len AS d FROM m WHERE won UNION ALL SELECT 2100, counter // 1000, byte_len FROM m WHERE won) GROUP BY epoch, counter""")
def e15(t):
    move = t.extent.where("epoch = 1998 and counter % 10 < 3")
    # every other move was overtaken by a write: its old location is no longer the map's
    moves = move.withColumn("frame_index", F.when(c("frame_index") % 2 == 0, c("frame_index")).otherwise(c("frame_index") + 100_000)).withColumn("new_epoch", F.lit(2100).cast("long")).withColumn("new_counter", F.floor(c("counter") / 1000))
    return liveness.repoint(t.extent, moves)[1]


@query("e16_index_consistency", "SELECT coalesce(e.dir_id, s.dir_id) AS dir_id, coalesce(e.cookie, s.cookie) AS cookie, e.name AS entry_name, s.name AS scan_name, CASE WHEN s.name IS NULL THEN 'entry_without_scan' WHEN e.name IS NULL THEN 'scan_without_entry' ELSE 'name_mismatch' END AS violation FROM dir_entry e FULL JOIN dir_scan s ON e.dir_id = s.dir_id AND e.cookie = s.cookie WHERE s.name IS NULL OR e.name IS NULL OR s.name <> e.name")
def e16(t):
    return liveness.scan_consistency(t.dir_entry, t.dir_scan)


_STATE = "SELECT value, CASE WHEN arg_max(type, seq) = 'info' THEN 'unknown' WHEN arg_max(f, seq) = 'add' THEN 'present' ELSE 'absent' END AS state FROM history WHERE type <> 'fail' GROUP BY value"


@query("e17_result_audit", f"SELECT value, 'lost' AS verdict FROM ({_STATE}) WHERE state = 'present' AND value NOT IN (SELECT value FROM final_read) UNION ALL SELECT value, 'resurrected' FROM ({_STATE}) WHERE state = 'absent' AND value IN (SELECT value FROM final_read)")
def e17(t):
    return set_audit(t.history, t.final_read)


@query("h8_browser_order", "SELECT row_number() OVER (ORDER BY kind <> 'directory', size DESC, name DESC) AS place, name, size FROM inode WHERE name IS NOT NULL QUALIFY place <= 300")
def h8(t):
    rows = t.inode.where("name is not null").withColumn("is_dir", c("kind") == "directory")
    top = namespace.sorted_for_browser(rows, "size", descending=True).limit(300)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("is_dir"), F.desc("size"), F.desc("name")))  # 300 rows
    return top.select(place.cast("long").alias("place"), "name", "size")


@query("h9_search_limit", "SELECT inode_id, name FROM dir_scan WHERE regexp_matches(name, '(?i)order-1') ORDER BY name, inode_id LIMIT 100")
def h9(t):
    return t.dir_scan.where(c("name").rlike("(?i)order-1")).orderBy("name", "inode_id").limit(100).select("inode_id", "name")
