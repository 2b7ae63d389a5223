"""Queries of the key and value codecs (survey group C, C1 to C9, C26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.plans.registry import query
from tidemark.sources import objects
from tidemark.sources.sinks import kept

c = F.col


@query("c1_encode_keys", """SELECT 'INODE' AS kind, inode_id AS a, CAST(0 AS BIGINT) AS b, '6D65746101' || printf('%016X', inode_id) AS key FROM inode UNION ALL SELECT 'EXTENT', inode, extent, '657874656E74FE' || printf('%016X', inode) || printf('%016X', extent) FROM extent
  UNION ALL SELECT 'SEGCOUNT', epoch, counter, '6D65746109' || printf('%016X', epoch) || printf('%016X', counter) FROM segcount UNION ALL SELECT 'DIR_SCAN', dir_id, cookie, '6D65746103' || printf('%016X', dir_id) || printf('%016X', cookie) FROM dir_entry
  UNION ALL SELECT 'TOMBSTONE', ts, inode_id, '6D65746107' || printf('%016X', ts) || printf('%016X', inode_id) FROM tombstone UNION ALL SELECT 'ORPHAN', inode_id, 0, '6D65746108' || printf('%016X', inode_id) FROM orphan
  UNION ALL SELECT 'DIR_COOKIE', dir_id, 0, '6D65746104' || printf('%016X', dir_id) FROM dir_cookie UNION ALL SELECT 'STATS', shard_id, 0, '6D65746105' || printf('%016X', shard_id) FROM stats_shard""")
def c1(t):
    none = F.lit(0).cast("long")
    tables = {"INODE": (t.inode, ["inode_id"]), "EXTENT": (t.extent, ["inode", "extent"]), "SEGCOUNT": (t.segcount, ["epoch", "counter"]), "DIR_SCAN": (t.dir_entry, ["dir_id", "cookie"]), "TOMBSTONE": (t.tombstone, ["ts", "inode_id"]), "ORPHAN": (t.orphan, ["inode_id"]), "DIR_COOKIE": (t.dir_cookie, ["dir_id"]), "STATS": (t.stats_shard, ["shard_id"])}
    out = None
    for kind, (rows, ids) in tables.items():
        part = rows.select(F.lit(kind).alias("kind"), c(ids[0]).alias("a"), (c(ids[1]) if len(ids) > 1 else none).alias("b"), F.hex(codec.key(kind, *map(c, ids))).alias("key"))
        out = part if out is None else out.unionAll(part)
    return out


@query("c2_parse_keys", "SELECT inode, extent, inode AS parsed_inode, extent AS parsed_extent, CAST(NULL AS BIGINT) AS wrong_kind, CAST(NULL AS BIGINT) AS wrong_length FROM extent")
def c2(t):
    key = codec.key("EXTENT", c("inode"), c("extent"))
    return t.extent.select("inode", "extent", codec.parse("EXTENT", key, 0).cast("long").alias("parsed_inode"), codec.parse("EXTENT", key, 1).cast("long").alias("parsed_extent"),
        codec.parse("SEGCOUNT", key, 0).cast("long").alias("wrong_kind"), codec.parse("EXTENT", F.substring(key, 1, 20), 0).cast("long").alias("wrong_length"))


@query("c3_describe_keys", "SELECT counter, 'SEGCOUNT' AS kind, concat('epoch=', CAST(epoch AS STRING), ', counter=', CAST(counter AS STRING)) AS detail, 'raw=6D65746109' || substr(printf('%016X', epoch), 1, 6) AS cut FROM segcount")
def c3(t):
    key = codec.key("SEGCOUNT", c("epoch"), c("counter"))
    return t.segcount.select("counter", codec.kind_of(key).alias("kind"), codec.describe(key).alias("detail"), codec.describe(F.substring(key, 1, 8)).alias("cut"))


def _little(value: str, size: int) -> str:
    text = f"printf('%016X', {value})"
    return " || ".join(f"substr({text}, {15 - 2 * k}, 2)" for k in range(size))


@query("c4_frame_location", f"SELECT inode, extent, {_little('epoch', 8)} || {_little('counter', 8)} || {_little('frame_index', 4)} || {_little('byte_offset', 8)} || {_little('byte_len', 4)} AS encoded, epoch, counter, frame_index, byte_offset, byte_len FROM extent")
def c4(t):
    rows = t.extent.withColumn("v", codec.frame_loc(c("epoch"), c("counter"), c("frame_index"), c("byte_offset"), c("byte_len")))
    return rows.select("inode", "extent", F.hex("v").alias("encoded"), *[x.cast("long").alias(k) for k, x in codec.frame_loc_fields(c("v")).items()])


@query("c5_segcount_value", "SELECT epoch, counter, live, CASE WHEN counter % 3 = 0 THEN live ELSE total END AS total FROM segcount WHERE counter % 3 < 2 UNION ALL SELECT epoch, counter, NULL, NULL FROM segcount WHERE counter % 3 = 2")
def c5(t):
    v = F.when(c("counter") % 3 == 0, F.unhex(codec.le64(c("live")))).when(c("counter") % 3 == 1, codec.segcount_value(c("live"), c("total"))).otherwise(F.unhex(F.lit("00FF")))
    rows = t.segcount.withColumn("v", v)
    return rows.select("epoch", "counter", *[x.cast("long").alias(k) for k, x in codec.segcount_fields(c("v")).items()])


@query("c6_entry_values", "SELECT dir_id, inode_id, cookie, CAST(NULL AS BIGINT) AS short FROM dir_entry")
def c6(t):
    v = F.unhex(F.concat(codec.le64(c("inode_id")), codec.le64(c("cookie"))))
    rows = t.dir_entry.withColumn("v", v)
    back = codec.entry_fields(c("v"))
    return rows.select("dir_id", back["inode_id"].cast("long").alias("inode_id"), back["cookie"].cast("long").alias("cookie"), codec.entry_fields(F.substring(c("v"), 1, 12))["cookie"].cast("long").alias("short"))


@query("c7_leadership_stamp", "SELECT seqno, op_index, CASE key % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS version, CASE WHEN key % 4 < 3 THEN epoch END AS epoch, CASE WHEN key % 4 IN (1, 2) THEN value END AS extra, CASE WHEN key % 4 = 2 THEN printf('%016X', key) || printf('%016X', value) END AS lineage FROM change")
def c7(t):
    size = F.element_at(F.array(F.lit(16), F.lit(24), F.lit(40), F.lit(23)), (c("key") % 4 + 1).cast("int"))
    whole = F.unhex(F.concat(codec.le64(c("epoch")), codec.le64(c("seqno")), codec.le64(c("value")), codec.be64(c("key")), codec.be64(c("value"))))
    f = codec.stamp_fields(F.substring(whole, F.lit(1), size))
    return t.change.select("seqno", "op_index", f["version"].alias("version"), f["epoch"].cast("long").alias("epoch"), f["extra"].cast("long").alias("extra"), f["lineage"].alias("lineage"))


@query("c8_scan_value", "SELECT dir_id, cookie, name, inode_id FROM dir_entry")
def c8(t):
    f = codec.scan_fields(c("v"))
    return t.dir_entry.withColumn("v", codec.scan_value(c("name"), c("inode_id"))).select("dir_id", "cookie", f["name"].alias("name"), f["inode_id"].cast("long").alias("inode_id"))


@query("c9_object_key", "SELECT 'segments/' || printf('%02x', counter & 255) || '/' || printf('%016x', epoch) || '/' || printf('%016x', counter) AS path, epoch, counter, CAST(NULL AS BIGINT) AS bad FROM segcount")
def c9(t):
    rows = t.segcount.withColumn("path", codec.object_key(c("epoch"), c("counter")))
    f = codec.object_key_fields(c("path"))
    bad = codec.object_key_fields(F.concat(c("path"), F.lit("0")))
    return rows.select("path", f["epoch"].cast("long").alias("epoch"), f["counter"].cast("long").alias("counter"), bad["epoch"].cast("long").alias("bad"))


@query("c26_frame_checksum", "SELECT epoch, counter, CAST(count(*) AS BIGINT) AS frames, CAST(sum(length(CAST(inode AS VARCHAR) || ':' || CAST(extent AS VARCHAR) || ';') * (1 + byte_len % 40)) AS BIGINT) AS bytes, 'whole' AS status, 'checksum' AS damaged FROM frame GROUP BY epoch, counter")
def c26(t):
    """Segment objects of compressed frames, read back whole and with a damaged directory."""
    text = F.expr("repeat(concat(inode, ':', extent, ';'), cast(1 + byte_len % 40 as int))")
    sealed = kept(objects.seal(t.frame.withColumn("payload", text.cast("binary"))))
    whole = objects.status(sealed).select("epoch", "counter", "status")
    broken = objects.status(objects.damaged(sealed)).select("epoch", "counter", c("status").alias("damaged"))
    read = objects.read_frames(sealed).groupBy("epoch", "counter").agg(F.count("*").alias("frames"), F.sum(F.octet_length("payload")).alias("bytes"))
    return read.join(whole, ["epoch", "counter"]).join(broken, ["epoch", "counter"])
