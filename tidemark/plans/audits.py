"""Integrity audit queries (survey group I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit
from tidemark.operators.liveness import scan_consistency
from tidemark.plans.registry import query

c = F.col


_MET = """WITH RECURSIVE reach AS (SELECT CAST(0 AS BIGINT) AS dir_id UNION SELECT e.inode_id FROM reach r JOIN dir_entry e ON e.dir_id = r.dir_id), met AS (SELECT e.* FROM dir_entry e JOIN reach ON reach.dir_id = e.dir_id) """


@query("i1_dangling_entries", _MET + "SELECT dir_id, name, inode_id FROM met WHERE inode_id NOT IN (SELECT inode_id FROM inode)")
def i1(t):
    return audit.dangling_entries(t.dir_entry, t.inode)


@query("i2_entry_counts", "SELECT i.inode_id, i.entry_count AS stored, CAST(count(e.inode_id) AS BIGINT) AS actual FROM inode i LEFT JOIN dir_entry e ON e.dir_id = i.inode_id WHERE i.kind = 'directory' GROUP BY i.inode_id, i.entry_count HAVING i.entry_count <> count(e.inode_id)")
def i2(t):
    return audit.entry_counts(t.inode, t.dir_entry).select("inode_id", "stored", "actual")


@query("i3_link_counts", _MET + "SELECT i.inode_id, i.nlink, CAST(count(*) AS BIGINT) AS refs FROM inode i JOIN met e ON e.inode_id = i.inode_id WHERE kind <> 'directory' GROUP BY i.inode_id, i.nlink HAVING i.nlink <> count(*)")
def i3(t):
    return audit.link_counts(t.inode, t.dir_entry)


@query("i4_unreferenced_inodes", _MET + "SELECT inode_id, kind FROM inode WHERE inode_id <> 0 AND inode_id NOT IN (SELECT inode_id FROM met) AND inode_id NOT IN (SELECT inode_id FROM orphan)")
def i4(t):
    return audit.unreferenced(t.inode, t.dir_entry, t.orphan)


@query("i5_leftover_orphans", "SELECT inode_id FROM orphan")
def i5(t):
    return t.orphan


@query("i6_usage_counters", _MET + """SELECT 'used_bytes' AS metric, CAST((SELECT sum(used_bytes) FROM stats_shard) AS BIGINT) AS stored, CAST(sum(CASE WHEN kind = 'file' THEN size ELSE 0 END) AS BIGINT) AS computed FROM inode WHERE inode_id <> 0 AND inode_id IN (SELECT inode_id FROM met)
  UNION ALL SELECT 'used_inodes', CAST((SELECT sum(used_inodes) FROM stats_shard) AS BIGINT), count(*) FROM inode WHERE inode_id <> 0 AND inode_id IN (SELECT inode_id FROM met)""")
def i6(t):
    return audit.usage(t.inode, t.dir_entry, t.stats_shard)


@query("i7_live_tombstones", "SELECT ts, inode_id FROM tombstone WHERE inode_id IN (SELECT inode_id FROM inode)")
def i7(t):
    return audit.live_tombstones(t.tombstone, t.inode)


@query("i8_directory_links", "SELECT i.inode_id, i.nlink, 2 + CAST(count(d.inode_id) AS BIGINT) AS expected FROM inode i LEFT JOIN dir_entry e ON e.dir_id = i.inode_id LEFT JOIN (SELECT inode_id FROM inode WHERE kind = 'directory') d ON d.inode_id = e.inode_id WHERE i.kind = 'directory' GROUP BY i.inode_id, i.nlink HAVING i.nlink <> 2 + count(d.inode_id)")
def i8(t):
    return audit.directory_links(t.inode, t.dir_entry)


_FILES = "SELECT inode_id, (size + 32767) // 32768 AS wanted FROM inode WHERE kind = 'file'"


@query("i9_missing_extents", f"SELECT f.inode_id, f.wanted, CAST(count(x.extent) AS BIGINT) AS have FROM ({_FILES}) f LEFT JOIN extent x ON x.inode = f.inode_id AND x.extent < f.wanted GROUP BY f.inode_id, f.wanted HAVING count(x.extent) <> f.wanted")
def i9(t):
    return audit.missing_extents(t.inode, t.extent)


@query("i10_extents_past_end", f"SELECT x.inode, x.extent, f.wanted FROM extent x JOIN ({_FILES}) f ON f.inode_id = x.inode WHERE x.extent >= f.wanted")
def i10(t):
    return audit.extents_past_end(t.inode, t.extent)


@query("i11_unreadable_extents", "SELECT inode, extent, epoch, counter FROM extent WHERE counter % 211 = 3 AND frame_index = 0")
def i11(t):
    return audit.unreadable_extents(t.extent, t.frame.where("not (counter % 211 = 3 and frame_index = 0)"))


@query("i12_inode_counter", "SELECT max(inode_id) AS max_id, CAST(10000000100 AS BIGINT) AS next_id FROM inode HAVING max(inode_id) >= 10000000100")
def i12(t):
    return audit.inode_counter(t.inode, 10_000_000_100)


@query("i13_ownerless_extents", "SELECT inode, CAST(count(*) AS BIGINT) AS extents FROM extent WHERE inode NOT IN (SELECT inode_id FROM inode) AND inode NOT IN (SELECT inode_id FROM tombstone) GROUP BY inode")
def i13(t):
    return audit.ownerless_extents(t.extent, t.inode, t.tombstone)


def _scan(kind, sql):
    query(kind, sql)(lambda t, k=kind.split("_", 1)[1]: scan_consistency(t.dir_entry, t.dir_scan).where(c("violation") == k).select("dir_id", "cookie"))


_scan("i14_entry_without_scan", "SELECT dir_id, cookie FROM dir_entry EXCEPT SELECT dir_id, cookie FROM dir_scan")
_scan("i15_name_mismatch", "SELECT e.dir_id, e.cookie FROM dir_entry e JOIN dir_scan s ON s.dir_id = e.dir_id AND s.cookie = e.cookie WHERE s.name <> e.name")
_scan("i16_scan_without_entry", "SELECT dir_id, cookie FROM dir_scan EXCEPT SELECT dir_id, cookie FROM dir_entry")


@query("i17_stale_embedded", "SELECT s.dir_id, s.cookie, s.inode_id FROM dir_scan s JOIN inode i ON i.inode_id = s.inode_id WHERE s.e_size IS NOT NULL AND (s.e_size, s.e_mode, s.e_uid) IS DISTINCT FROM (i.size, i.mode, i.uid)")
def i17(t):
    return audit.stale_embedded(t.dir_scan, t.inode)


@query("i18_cookie_counters", "SELECT k.dir_id, k.next_cookie, m.max_cookie FROM dir_cookie k JOIN (SELECT dir_id, max(cookie) AS max_cookie FROM dir_entry GROUP BY dir_id) m ON m.dir_id = k.dir_id WHERE k.next_cookie <= m.max_cookie")
def i18(t):
    return audit.cookie_counters(t.dir_cookie, t.dir_entry)


_NODIR = "SELECT dir_id, CAST(count(*) AS BIGINT) AS rows FROM {} WHERE dir_id <> 0 AND dir_id NOT IN (SELECT inode_id FROM inode WHERE kind = 'directory') GROUP BY dir_id"
_TO_FILES = "(SELECT CASE WHEN inode_id % 997 = 1 THEN inode_id ELSE dir_id END AS dir_id FROM {})"


def _moved(rows):
    return rows.withColumn("dir_id", F.when(c("inode_id") % 997 == 1, c("inode_id")).otherwise(c("dir_id")))


@query("i19_entries_of_files", _NODIR.format(_TO_FILES.format("dir_entry")))
def i19(t):
    return audit.not_directories(_moved(t.dir_entry), t.inode)


@query("i20_scan_rows_of_files", _NODIR.format(_TO_FILES.format("dir_scan")))
def i20(t):
    return audit.not_directories(_moved(t.dir_scan), t.inode)


@query("i21_cookies_of_files", _NODIR.format("dir_cookie"))
def i21(t):
    return audit.not_directories(t.dir_cookie, t.inode)


@query("i22_audit_summary", "SELECT CAST(count(*) AS BIGINT) AS inodes, count(CASE WHEN kind = 'directory' THEN 1 END) AS directories, count(CASE WHEN kind = 'file' THEN 1 END) AS files, (SELECT count(*) FROM orphan) AS orphans FROM inode")
def i22(t):
    return audit.summary(t.inode, t.orphan)
