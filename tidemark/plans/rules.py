"""Queries of scalar rules and predicates (survey groups C10 to C27 and D)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import attributes as a
from tidemark.plans.registry import query

c = F.col


@query("c10_attributes", "SELECT inode_id, CASE kind WHEN 'directory' THEN 4096 WHEN 'file' THEN size WHEN 'symlink' THEN size ELSE 0 END AS size, CASE kind WHEN 'file' THEN 1 WHEN 'directory' THEN 2 WHEN 'block_device' THEN 3 WHEN 'char_device' THEN 4 WHEN 'symlink' THEN 5 WHEN 'socket' THEN 6 ELSE 7 END AS type FROM inode")
def c10(t):
    return t.inode.select("inode_id", a.attribute_size(c("kind"), c("size"), c("size")).alias("size"), a.file_type(c("kind")).alias("type"))


@query("c11_fallocate_bits", "SELECT * FROM (VALUES ('allocate', 0), ('keep_size', 1), ('punch_hole', 3), ('zero_range', 16), ('zero_range_keep_size', 17), ('other', NULL)) v(mode, bits)")
def c11(t):
    modes = F.explode(F.array(*map(F.lit, ["allocate", "keep_size", "punch_hole", "zero_range", "zero_range_keep_size", "other"]))).alias("mode")
    return t.spark.range(1).select(modes).select("mode", a.fallocate_bits(c("mode")).alias("bits"))


@query("c12_size_delta", "SELECT inode, extent, byte_len - byte_offset AS delta, -9223372036854775807 AS low FROM extent WHERE extent = 0")
def c12(t):
    huge = F.lit("18446744073709551615").cast("decimal(20,0)")
    return t.extent.where("extent = 0").select("inode", "extent", a.size_delta(c("byte_offset"), c("byte_len")).alias("delta"), a.size_delta(huge, F.lit(0)).alias("low"))


@query("c13_shard", "SELECT inode_id % 100 AS shard, CAST(count(*) AS BIGINT) AS inodes FROM inode GROUP BY inode_id % 100")
def c13(t):
    return t.inode.groupBy(a.shard_of(c("inode_id")).alias("shard")).agg(F.count("*").alias("inodes"))


@query("c14_live_permille", "SELECT epoch, counter, live * 1000 // greatest(total, 1) AS permille FROM segcount")
def c14(t):
    return t.segcount.select("epoch", "counter", a.live_permille(c("live"), c("total")).alias("permille"))


@query("c15_dead_percent", "SELECT epoch, counter, CASE WHEN total > 0 THEN (total - live) * 100 // total ELSE 0 END AS dead FROM segcount")
def c15(t):
    return t.segcount.select("epoch", "counter", a.dead_percent(c("live"), c("total")).alias("dead"))


@query("c16_extent_ranges", "SELECT event_id, (length + 32767) // 32768 AS extents, \"offset\" // 32768 AS first, (\"offset\" + length - 1) // 32768 AS last FROM access")
def c16(t):
    first, last = a.extent_range(c("offset"), c("length"))
    return t.access.select("event_id", a.extent_count(c("length")).alias("extents"), first.alias("first"), last.alias("last"))


def _human(n: str, units: list[str], whole: bool) -> str:
    text = " ".join(f"WHEN {n} < {1024.0 ** (k + 1)!r} OR {k + 1} = {len(units)} THEN {f'CAST({n} AS STRING)' if k == 0 and whole else f'''printf('%.1f', {n} / {1024.0**k!r})'''} || ' {u}'" for k, u in enumerate(units))
    return f"CASE {text} END"


@query("c17_human_bytes", f"SELECT epoch, counter, {_human('total', ['B', 'KiB', 'MiB', 'GiB', 'TiB'], True)} AS total FROM segcount")
def c17(t):
    return t.segcount.select("epoch", "counter", a.human_bytes(c("total")).alias("total"))


@query("c18_human_bytes_ui", f"SELECT epoch, counter, {_human('live', ['B', 'KB', 'MB', 'GB', 'TB', 'PB', 'EB'], False)} AS live FROM segcount")
def c18(t):
    return t.segcount.select("epoch", "counter", a.human_bytes_ui(c("live")).alias("live"))


@query("c19_validity", "SELECT dir_id, name, octet_length(encode(repeat(name, 20))) <= 255 AS ok, mode & 4095 AS masked FROM dir_entry JOIN inode USING (inode_id)".replace("SELECT dir_id, name,", "SELECT dir_id, dir_entry.name,").replace("repeat(name", "repeat(dir_entry.name"))
def c19(t):
    rows = t.dir_entry.join(t.inode.select("inode_id", "mode"), "inode_id")
    return rows.select("dir_id", "name", a.filename_ok(F.repeat("name", F.lit(20))).alias("ok"), a.mode_mask(c("mode")).alias("masked"))


@query("c20_paths", """SELECT i.inode_id, CASE WHEN i.inode_id = 0 THEN '/' WHEN i.parent IS NULL THEN concat('<inode:', CAST(i.inode_id AS STRING), '>') ELSE concat('/', concat_ws('/', r.name, n.name, u.name, i.name)) END AS path
  FROM inode i LEFT JOIN inode u ON u.inode_id = i.parent AND u.inode_id <> 0 AND i.inode_id <> 0 LEFT JOIN inode n ON n.inode_id = u.parent AND n.inode_id <> 0 LEFT JOIN inode r ON r.inode_id = n.parent AND r.inode_id <> 0""")
def c20(t):
    from tidemark.operators.namespace import paths

    return paths(t.inode)


@query("c21_lock_end", "SELECT inode, owner, start, length, CASE WHEN length = 0 THEN '18446744073709551615' ELSE CAST(start + length AS STRING) END AS stop FROM lock")
def c21(t):
    return t.lock.select("inode", "owner", "start", "length", a.range_end(c("start"), c("length")).cast("string").alias("stop"))


@query("c22_unordered_pairs", "SELECT least(epoch_a * 10000 + counter_a, epoch_b * 10000 + counter_b) AS low, greatest(epoch_a * 10000 + counter_a, epoch_b * 10000 + counter_b) AS high, CAST(count(*) AS BIGINT) AS n FROM seam_event GROUP BY ALL")
def c22(t):
    low, high = a.unordered(F.struct("epoch_a", "counter_a"), F.struct(c("epoch_b").alias("epoch_a"), c("counter_b").alias("counter_a")))
    return t.seam_event.groupBy(low.alias("x"), high.alias("y")).agg(F.count("*").alias("n")).select((c("x.epoch_a") * 10000 + c("x.counter_a")).alias("low"), (c("y.epoch_a") * 10000 + c("y.counter_a")).alias("high"), "n")


@query("c23_counter_rates", "SELECT ts, greatest(read_ops - lag(read_ops) OVER w, 0) * 1.0::DOUBLE / (ts - lag(ts) OVER w) AS rate FROM snapshot WINDOW w AS (ORDER BY ts) QUALIFY lag(ts) OVER w IS NOT NULL")
def c23(t):
    from tidemark.operators.series import rates

    return rates(t.snapshot, "ts", ["read_ops"]).where("dt is not null").select("ts", c("read_ops_rate").alias("rate"))


@query("c24_search_patterns", """SELECT q AS query, CAST(count(*) AS BIGINT) AS hits FROM dir_entry, (VALUES ('order-1?', '(?i)^order-1.$'), ('ORDER-77', '(?i)ORDER-77'), ('/nation_[12]+$/i', '(?i)nation_[12]+$'), ('link-*', '(?i)^link-.*$'), ('a.b', '(?i)a\\.b')) v(q, re) WHERE regexp_matches(name, re) GROUP BY q""")
def c24(t):
    queries = ["order-1?", "ORDER-77", "/nation_[12]+$/i", "link-*", "a.b"]
    asked = t.spark.range(1).select(F.explode(F.array(*map(F.lit, queries))).alias("query")).withColumn("re", a.query_pattern(c("query")))
    # a handful of searches against every name, the searches being the small side
    return t.dir_entry.join(F.broadcast(asked), F.expr("name rlike re")).groupBy("query").agg(F.count("*").alias("hits"))


@query("c25_event_text", """SELECT event_id, CASE WHEN operation IN ('read', 'write') THEN concat('offset=', CAST("offset" AS STRING), ' length=', CAST(length AS STRING)) WHEN operation = 'create' THEN 'mode=' || lpad(CAST((event_id % 512 // 64) * 100 + event_id % 64 // 8 * 10 + event_id % 8 AS STRING), 4, '0') ELSE '' END AS text FROM access""")
def c25(t):
    return t.access.select("event_id", a.event_text(c("operation"), c("offset"), c("length"), c("event_id") % 512).alias("text"))


@query("c27_zero_extents", "SELECT inode, extent, byte_len % 5 = 0 AS hole FROM extent")
def c27(t):
    data = F.when(c("byte_len") % 5 == 0, F.unhex(F.repeat(F.lit("00"), F.lit(32)))).otherwise(F.unhex(F.concat(F.repeat(F.lit("00"), F.lit(31)), F.lit("10"))))
    return t.extent.select("inode", "extent", a.is_hole(data).alias("hole"))


_ACCESS = "CASE WHEN {who} = 0 THEN {root} WHEN {who} = uid THEN mode & ({bit} * 64) <> 0 WHEN {known} THEN mode & ({bit} * 8) <> 0 WHEN NOT {full} THEN mode & ({bit} * 9) <> 0 ELSE mode & {bit} <> 0 END"
_WHO, _FULL, _GID = "(inode_id % 8)", "(inode_id % 3 <> 0)", "(inode_id % 4)"
_KNOWN = f"(gid = {_GID} OR gid = 3)"


def _creds(t):
    who, own, full = c("inode_id") % 8, c("inode_id") % 4, c("inode_id") % 3 != 0
    known, maybe = a.member(c("gid"), own, F.lit(True), F.array(F.lit(3).cast("long")), full)
    return who, known, maybe, full


@query("d1_access", "SELECT inode_id, " + ", ".join(f"{_ACCESS.format(who=_WHO, known=_KNOWN, full=_FULL, bit=b, root='mode & 73 <> 0' if b == 1 else 'true')} AS {n}" for n, b in (("may_read", 4), ("may_write", 2), ("may_execute", 1))) + " FROM inode")
def d1(t):
    who, known, _, full = _creds(t)
    return t.inode.select("inode_id", *[a.access(c("mode"), c("uid"), c("gid"), who, known, full, b).alias(n) for n, b in (("may_read", 4), ("may_write", 2), ("may_execute", 1))])


@query("d2_group_member", f"SELECT inode_id, {_KNOWN} AS known, {_KNOWN} OR NOT {_FULL} AS maybe FROM inode")
def d2(t):
    _, known, maybe, _ = _creds(t)
    return t.inode.select("inode_id", known.alias("known"), maybe.alias("maybe"))


@query("d3_ownership", f"""SELECT i.inode_id, {_WHO.replace('inode_id', 'i.inode_id')} IN (0, i.uid) AS owns, NOT (p.kind = 'directory' AND p.mode & 512 <> 0 AND {_WHO.replace('inode_id', 'i.inode_id')} NOT IN (0, p.uid, i.uid)) AS may_delete, {_WHO.replace('inode_id', 'i.inode_id')} IN (0, i.uid) OR i.inode_id % 2 = 0 AND i.mode & 2 <> 0 AS may_set_times
  FROM inode i JOIN inode p ON p.inode_id = i.parent WHERE i.inode_id <> 0""")
def d3(t):
    p = t.inode.select(c("inode_id").alias("parent"), c("kind").alias("p_kind"), c("mode").alias("p_mode"), c("uid").alias("p_uid"))
    rows, who = t.inode.where("inode_id <> 0").join(p, "parent"), c("inode_id") % 8
    sticky = a.may_delete(c("p_kind") == "directory", c("p_mode"), c("p_uid"), c("uid"), who)
    return rows.select("inode_id", a.owns(who, c("uid")).alias("owns"), sticky.alias("may_delete"), a.may_set_times(who, c("uid"), c("inode_id") % 2 == 0, c("mode").bitwiseAND(2) != 0).alias("may_set_times"))


@query("d4_reclaim_eligible", "SELECT epoch, counter FROM segcount WHERE epoch < 1998 OR epoch = 1998 AND counter < 1000")
def d4(t):
    at = F.struct(c("epoch"), c("counter"))
    return t.segcount.where(at < F.struct(F.lit(1998).cast("long").alias("epoch"), F.lit(1000).cast("long").alias("counter"))).select("epoch", "counter")


@query("d5_segment_class", "SELECT epoch, counter, CASE WHEN live = 0 THEN 'dead' WHEN live * 2 < total OR total < 50000 THEN 'candidate' WHEN (total - live) * 100 > total * 5 THEN 'tail' ELSE 'keep' END AS class FROM segcount")
def d5(t):
    from tidemark.operators.accounting import classify

    return classify(t.segcount, small=50_000, floor_percent=5).select("epoch", "counter", "class")


@query("d6_write_cold", "SELECT epoch, counter, epoch <> 2000 OR greatest(2000 - counter, 0) >= 30 AS cold FROM segcount")
def d6(t):
    from tidemark.operators.accounting import write_cold

    return t.segcount.select("epoch", "counter", write_cold(c("epoch"), c("counter"), 2000, 2000).alias("cold"))


@query("d7_age_gate", "SELECT epoch, counter, mtime, size FROM segment_object WHERE mtime < 799000")
def d7(t):
    return t.segment_object.where("mtime < 799000")


@query("d8_idle", "SELECT ts, coalesce(read_ops - lag(read_ops) OVER w <= 0 AND write_ops - lag(write_ops) OVER w <= 0, false) AS idle FROM snapshot WINDOW w AS (ORDER BY ts)")
def d8(t):
    from tidemark.operators.series import idle

    return idle(t.snapshot, "ts", ["read_ops", "write_ops"]).select("ts", "idle")


@query("d9_quota", "SELECT event_id, length, (SELECT sum(used_bytes) FROM stats_shard) + length > 1000000000 AS over FROM access WHERE operation = 'write'")
def d9(t):
    used = t.stats_shard.agg(F.sum("used_bytes").alias("used"))  # one row
    return t.access.where("operation = 'write'").crossJoin(F.broadcast(used)).select("event_id", "length", (c("used") + c("length") > 1_000_000_000).alias("over"))


@query("d10_location_guard", "SELECT f.inode, f.extent, count(x.inode) > 0 AS current FROM frame f LEFT JOIN extent x ON x.inode = f.inode AND x.extent = f.extent AND x.epoch = f.epoch AND x.counter = f.counter AND x.frame_index = f.frame_index AND x.byte_offset = f.byte_offset AND x.byte_len = f.byte_len GROUP BY f.inode, f.extent, f.epoch, f.counter, f.frame_index")
def d10(t):
    on = ["inode", "extent", "epoch", "counter", "frame_index", "byte_offset", "byte_len"]
    return t.frame.join(t.extent.withColumn("x", F.lit(True)), on, "left").select("inode", "extent", c("x").isNotNull().alias("current"))


@query("d11_no_op_deltas", "SELECT inode, CAST(sum(byte_len % 3 - 1) AS BIGINT) AS bytes FROM frame GROUP BY inode HAVING sum(byte_len % 3 - 1) <> 0")
def d11(t):
    from tidemark.operators.accounting import without_no_ops

    return without_no_ops(t.frame.groupBy("inode").agg(F.sum(c("byte_len") % 3 - 1).alias("bytes")), ["bytes"])


@query("d12_named_checkpoints", "SELECT id, name FROM checkpoint WHERE name <> ''")
def d12(t):
    return t.checkpoint.where(F.length("name") > 0).select("id", "name")


@query("d13_stale_epochs", "SELECT seqno, op_index, epoch FROM (SELECT *, max(epoch) OVER (ORDER BY seqno, op_index ROWS UNBOUNDED PRECEDING) AS top FROM change) WHERE epoch >= top")
def d13(t):
    from tidemark.operators.changelog import accepted_epochs

    return accepted_epochs(t.change).select("seqno", "op_index", "epoch")
