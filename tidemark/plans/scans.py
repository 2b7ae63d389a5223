"""Queries of scans, listings, sources and sinks (survey groups A, B and H6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import scan
from tidemark.plans.registry import query
from tidemark.sources import sinks, storage

FIRST_FILE = 10_000_000_000


@query("a1_point_get", "SELECT * FROM extent WHERE inode IN (SELECT 10000000000 + event_id * 3 FROM events WHERE event_id < 200) AND extent < 2")
def a1(t):
    keys = t.events.where("event_id < 200").select((FIRST_FILE + F.col("event_id") * 3).alias("inode")).crossJoin(t.spark.range(2).withColumnRenamed("id", "extent"))  # two extents of each
    return scan.point_get(t.extent, keys, ["inode", "extent"]).select(*t.extent.columns)


@query("a2_point_get_durable", "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY epoch DESC, seqno DESC, op_index DESC) AS rn FROM change WHERE seqno <= 900) WHERE rn = 1 AND op <> 'delete' AND key % 7 = 1")
def a2(t):
    view = scan.latest(scan.durable(t.change, 900), ["key"], ["epoch", "seqno", "op_index"])
    keys = t.change.where("key % 7 = 1").select("key")
    return scan.point_get(view, keys, ["key"]).select("key", "value")


@query("a3_range_scan", "SELECT * FROM extent WHERE inode >= 10000000100 AND inode < 10000000900 ORDER BY inode, extent")
def a3(t):
    return scan.range_scan(t.extent, ["inode", "extent"], [FIRST_FILE + 100, 0], [FIRST_FILE + 900, 0])


@query("a4_range_scan_durable", "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY epoch DESC, seqno DESC, op_index DESC) AS rn FROM change WHERE seqno <= 1200) WHERE rn = 1 AND op <> 'delete' AND key >= 100 AND key < 300")
def a4(t):
    view = scan.latest(scan.durable(t.change, 1200), ["key"], ["epoch", "seqno", "op_index"])
    return scan.range_scan(view, ["key"], [100], [300]).select("key", "value")


@query("a5_prefix_scan", "SELECT * FROM dir_entry WHERE dir_id = 107 AND cookie >= 20 ORDER BY cookie")
def a5(t):
    return scan.prefix_scan(t.dir_entry, {"dir_id": 107}, {"cookie": 20})


@query("a6_scan_by_kind", "SELECT inode_id, size, mode FROM inode WHERE kind = 'symlink'")
def a6(t):
    return t.inode.where("kind = 'symlink'").select("inode_id", "size", "mode")


@query("a7_decode_key_space", """SELECT 'INODE' AS kind, concat('inode_id=', CAST(inode_id AS STRING)) AS detail FROM inode UNION ALL SELECT 'EXTENT', concat('inode_id=', CAST(inode AS STRING), ', extent_index=', CAST(extent AS STRING)) FROM extent
  UNION ALL SELECT 'SEGCOUNT', concat('epoch=', CAST(epoch AS STRING), ', counter=', CAST(counter AS STRING)) FROM segcount UNION ALL SELECT 'DIR_ENTRY', concat('dir_id=', CAST(dir_id AS STRING), ', name="', name, '"') FROM dir_entry""")
def a7(t):
    raw = storage.key_space(t).select("key")
    return raw.select(codec.kind_of(F.col("key")).alias("kind"), codec.describe(F.col("key")).alias("detail"))


@query("a8_directory_list", "SELECT cookie, name, inode_id FROM dir_scan WHERE dir_id = 112 AND cookie > 10 ORDER BY cookie")
def a8(t):
    return t.dir_scan.where("dir_id = 112 and cookie > 10").select("cookie", "name", "inode_id").orderBy("cookie")


@query("a9_tombstone_list", "SELECT * FROM tombstone ORDER BY ts, inode_id")
def a9(t):
    return t.tombstone.orderBy("ts", "inode_id")


@query("a10_orphan_contains", "SELECT inode_id, kind FROM inode WHERE inode_id IN (SELECT inode_id FROM orphan)")
def a10(t):
    return t.inode.join(t.orphan, "inode_id", "left_semi").select("inode_id", "kind")


@query("a11_segment_listing", "SELECT CAST(counter & 255 AS BIGINT) AS prefix, CAST(count(*) AS BIGINT) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM segment_object GROUP BY counter & 255")
def a11(t):
    return storage.by_prefix(t.segment_object)


@query("a12_segment_directory", "SELECT epoch, counter, byte_offset, byte_len, inode, extent FROM frame WHERE epoch = 1997 AND counter % 100 = 7")
def a12(t):
    packed = storage.directories(t.frame)
    return storage.read_directories(packed.where("epoch = 1997 and counter % 100 = 7"))


@query("a13_frame_runs", "SELECT epoch, counter, CAST(count(*) AS BIGINT) AS frames, min(byte_offset) AS start, CAST(max(byte_offset + byte_len) AS BIGINT) AS stop FROM frame WHERE frame_index BETWEEN 1 AND 3 GROUP BY epoch, counter")
def a13(t):
    return storage.read_runs(t.frame, 1, 3)


@query("a14_checkpoints", "SELECT id, name, created_at FROM checkpoint WHERE length(name) > 0")
def a14(t):
    return storage.checkpoints(t.checkpoint)


@query("a15_snapshot_read", "SELECT count(*) AS entries, CAST(sum(byte_len) AS BIGINT) AS bytes FROM extent WHERE epoch <= 1997")
def a15(t):
    path = sinks.scratch(t.spark, "versions")
    sinks.checkpoint_create(t.extent.where("epoch <= 1997"), path, "before")
    sinks.checkpoint_create(t.extent, path, "after")
    return storage.snapshot(t.spark, path, "before").agg(F.count("*").alias("entries"), F.sum("byte_len").alias("bytes"))


@query("a16_storage_schemes", "SELECT * FROM (VALUES ('file:///a/b', 'file', true), ('s3a://bucket/x', 's3', true), ('s3://bucket/x', 's3', true), ('gs://b/k', 'gs', true), ('abfss://c@acct/x', 'azure', true), ('memory:///', 'memory', true), ('https://h/x', 'http', true), ('ftp://h/x', NULL, false)) v(url, store, known)")
def a16(t):
    urls = ["file:///a/b", "s3a://bucket/x", "s3://bucket/x", "gs://b/k", "abfss://c@acct/x", "memory:///", "https://h/x", "ftp://h/x"]
    df = t.spark.range(1).select(F.explode(F.array(*map(F.lit, urls))).alias("url"))
    store = storage.scheme(F.col("url"))
    return df.select("url", store.alias("store"), store.isNotNull().alias("known"))


@query("h6_listing_page", "WITH d AS (SELECT 1 AS cookie, '.' AS name, 105 AS inode_id UNION ALL SELECT 2, '..', 1 UNION ALL SELECT cookie, name, inode_id FROM dir_entry WHERE dir_id = 105) SELECT CAST(cookie AS BIGINT) AS cookie, name, CAST(inode_id AS BIGINT) AS inode_id, (SELECT count(*) FROM d WHERE cookie > 1) > 12 AS has_more FROM d WHERE cookie > 1 ORDER BY cookie LIMIT 12")
def h6(t):
    return scan.directory_page(t.dir_entry, 105, 1, 1, 12)


@query("h6_all_pages", "SELECT dir_id, page, min(cookie) AS first_cookie, max(cookie) AS last_cookie, CAST(count(*) AS BIGINT) AS entries FROM (SELECT *, (row_number() OVER (PARTITION BY dir_id ORDER BY cookie) - 1) // 10 AS page FROM dir_entry) GROUP BY dir_id, page")
def h6_all(t):
    return scan.pages(t.dir_entry, 10)


@query("b1_batch_write", "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY epoch DESC, seqno DESC, op_index DESC) AS rn FROM change) WHERE rn = 1 AND op <> 'delete'")
def b1(t):
    path = sinks.scratch(t.spark, "state")
    sinks.batch_write(t.change, path, ["key"], ["epoch", "seqno", "op_index"])
    return t.spark.read.parquet(path).select("key", "value")


@query("b2_batch_write_with_log", "SELECT op, CAST(count(*) AS BIGINT) AS n, CAST(sum(value) AS BIGINT) AS total FROM change GROUP BY op")
def b2(t):
    path = sinks.scratch(t.spark, "collected")
    sinks.batch_write(t.change, f"{path}/state", ["key"], ["epoch", "seqno", "op_index"], log=f"{path}/log")
    return t.spark.read.parquet(f"{path}/log").groupBy("op").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("b3_seal_segments", "SELECT CAST(counter & 255 AS BIGINT) AS prefix, CAST(count(*) AS BIGINT) AS frames, CAST(sum(byte_len) AS BIGINT) AS bytes FROM frame GROUP BY counter & 255")
def b3(t):
    path = sinks.scratch(t.spark, "segments")
    sinks.seal(t.frame, path)
    return t.spark.read.parquet(path).groupBy(F.col("prefix").cast("long").alias("prefix")).agg(F.count("*").alias("frames"), F.sum("byte_len").alias("bytes"))


@query("b4_delete_segments", "SELECT o.* FROM segment_object o WHERE NOT EXISTS (SELECT 1 FROM segcount s WHERE s.epoch = o.epoch AND s.counter = o.counter AND s.live = 0)")
def b4(t):
    return sinks.without(t.segment_object, t.segcount.where("live = 0"), ["epoch", "counter"])


@query("b5_materialize_missing", "SELECT epoch, counter, CAST(sum(byte_len) AS BIGINT) AS size FROM frame f WHERE NOT EXISTS (SELECT 1 FROM segment_object o WHERE o.epoch = f.epoch AND o.counter = f.counter) GROUP BY epoch, counter")
def b5(t):
    return sinks.missing(t.frame, t.segment_object)


@query("b6_flush_barrier", "SELECT epoch, CAST(max(seqno) AS BIGINT) AS durable_seqno, CAST(count(DISTINCT seqno) AS BIGINT) AS batches FROM change GROUP BY epoch")
def b6(t):
    path = sinks.scratch(t.spark, "flush")
    return sinks.flush(t.change, path)


@query("b7_checkpoint_versions", "SELECT 'a' AS version, count(*) AS entries FROM segcount UNION ALL SELECT 'c', count(*) FROM segcount WHERE live = 0")
def b7(t):
    path = sinks.scratch(t.spark, "checkpoints")
    for name, rows in (("a", t.segcount), ("b", t.segcount.where("live > 0")), ("c", t.segcount.where("live = 0"))):
        sinks.checkpoint_create(rows, path, name)
    sinks.checkpoint_delete(t.spark, path, "b")
    return sinks.checkpoint_list(t.spark, path)


@query("b8_metric_export", """SELECT ts, m AS metric, CASE m WHEN 'read_ops_total' THEN read_ops WHEN 'write_ops_total' THEN write_ops WHEN 'read_bytes_total' THEN read_bytes ELSE gauge END AS value
  FROM snapshot, (VALUES ('read_ops_total'), ('write_ops_total'), ('read_bytes_total'), ('errors')) v(m)""")
def b8(t):
    return sinks.metrics(t.snapshot, "ts", {"read_ops_total": "read_ops", "write_ops_total": "write_ops", "read_bytes_total": "read_bytes", "errors": "gauge"})


@query("b9_result_formats", "SELECT benchmark, CAST(count(*) AS BIGINT) AS ops, f AS format FROM bench_run, (VALUES ('csv'), ('json'), ('text')) v(f) GROUP BY benchmark, f")
def b9(t):
    rows = t.bench_run.groupBy("benchmark").agg(F.count("*").alias("ops"))
    return sinks.formats(rows, sinks.scratch(t.spark, "formats"))


@query("b10_statistics_report", "SELECT 'segments' AS line, format('{:,}', count(*)) AS text FROM segcount UNION ALL SELECT 'live bytes', format('{:,}', CAST(sum(live) AS BIGINT)) FROM segcount UNION ALL SELECT 'dead bytes', format('{:,}', CAST(sum(total - live) AS BIGINT)) FROM segcount")
def b10(t):
    return sinks.report(t.segcount, {"segments": F.count("*"), "live bytes": F.sum("live"), "dead bytes": F.sum(F.col("total") - F.col("live"))})
