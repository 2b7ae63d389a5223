"""Accounting queries (survey group F) and the flagship classification of segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import accounting
from tidemark.plans.registry import query

c = F.col

_CLASS = "CASE WHEN live = 0 THEN 'dead' WHEN live * 2 < total OR total < 50000 THEN 'candidate' WHEN (total - live) * 100 > total * 5 THEN 'tail' ELSE 'keep' END"


@query("segment_gc_classify", f"SELECT {_CLASS} AS class, CAST(count(*) AS BIGINT) AS segments, CAST(sum(total) AS BIGINT) AS total, CAST(sum(live) AS BIGINT) AS live, CAST(sum(total - live) AS BIGINT) AS dead, min(live * 1000 // greatest(total, 1)) AS min_permille, max(live * 1000 // greatest(total, 1)) AS max_permille FROM segcount WHERE epoch < 2001 OR epoch = 2001 AND counter < 3000 GROUP BY {_CLASS}")
def segment_gc_classify(t):
    """Old segments by class, from the frame log alone."""
    counts = accounting.segment_counts(t.frame_state)
    old = counts.where((c("epoch") < 2001) | (c("epoch") == 2001) & (c("counter") < 3000))
    rows = accounting.classify(old, small=50_000, floor_percent=5)
    return rows.groupBy("class").agg(F.count("*").alias("segments"), F.sum("total").alias("total"), F.sum("live").alias("live"), F.sum(c("total") - c("live")).alias("dead"), F.min("permille").alias("min_permille"), F.max("permille").alias("max_permille"))


@query("f1_totals", "SELECT CAST(sum(used_bytes) AS BIGINT) AS used_bytes, CAST(sum(used_inodes) AS BIGINT) AS used_inodes FROM stats_shard")
def f1(t):
    return t.stats_shard.agg(F.sum("used_bytes").alias("used_bytes"), F.sum("used_inodes").alias("used_inodes"))


_DELTA = "SELECT inode AS inode_id, CASE WHEN live THEN byte_len ELSE -byte_len END AS bytes, CASE WHEN extent = 0 AND live THEN 1 ELSE 0 END AS inodes FROM frame_state"


def _deltas(t):
    return t.frame_state.select(c("inode").alias("inode_id"), F.when(c("live"), c("byte_len")).otherwise(-c("byte_len")).alias("bytes"), F.when((c("extent") == 0) & c("live"), 1).otherwise(0).alias("inodes"))


@query("f2_shard_deltas", f"SELECT inode_id % 100 AS shard_id, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(inodes) AS BIGINT) AS inodes FROM ({_DELTA}) GROUP BY inode_id % 100")
def f2(t):
    return accounting.shard_deltas(_deltas(t))


@query("f3_apply_deltas", f"SELECT s.shard_id, CAST(greatest(s.used_bytes - d.bytes // 2000, 0) AS BIGINT) AS used_bytes, CAST(greatest(s.used_inodes + d.inodes, 0) AS BIGINT) AS used_inodes FROM stats_shard s JOIN (SELECT inode_id % 100 AS shard_id, sum(bytes) AS bytes, sum(inodes) AS inodes FROM ({_DELTA}) GROUP BY inode_id % 100) d USING (shard_id)")
def f3(t):
    deltas = accounting.shard_deltas(_deltas(t)).withColumn("bytes", -F.expr("bytes div 2000"))
    return accounting.apply_deltas(t.stats_shard, deltas, "shard_id", {"used_bytes": "bytes", "used_inodes": "inodes"})


@query("f4_segment_deltas", """WITH b AS (SELECT epoch, counter, live, total FROM segcount WHERE epoch < 1998), d AS (SELECT epoch, counter, CAST(sum(CASE WHEN live THEN byte_len ELSE -byte_len END) AS BIGINT) AS d_live, CAST(sum(CASE WHEN live THEN byte_len ELSE -5 END) AS BIGINT) AS d_total FROM frame_state WHERE epoch IN (1997, 1998) GROUP BY epoch, counter)
  SELECT epoch, counter, greatest(coalesce(b.live, 0) + coalesce(d_live, 0), 0) AS live, greatest(coalesce(b.total, 0), coalesce(b.total, 0) + coalesce(d_total, 0)) AS total, coalesce(b.total, 0) = 0 AND greatest(coalesce(b.total, 0), coalesce(b.total, 0) + coalesce(d_total, 0)) > 0 AS fresh FROM b FULL JOIN d USING (epoch, counter)""")
def f4(t):
    d = t.frame_state.where("epoch in (1997, 1998)")
    deltas = d.select("epoch", "counter", F.when(c("live"), c("byte_len")).otherwise(-c("byte_len")).alias("d_live"), F.when(c("live"), c("byte_len")).otherwise(-5).alias("d_total"))
    return accounting.segment_deltas(t.segcount.where("epoch < 1998"), deltas)


_FOOT = "SELECT CAST(count(*) AS BIGINT) AS segments, CAST(sum(live) AS BIGINT) AS live, CAST(sum(total) AS BIGINT) AS total, CAST(sum(total) - sum(live) AS BIGINT) AS reclaimable, CAST((sum(total) - sum(live)) * 100 // sum(total) AS BIGINT) AS dead_percent FROM segcount"


@query("f5_footprint", _FOOT)
def f5(t):
    return accounting.footprint(t.segcount)


@query("f6_incremental_footprint", "SELECT epoch, CAST(sum(n) OVER (ORDER BY epoch) AS BIGINT) AS segments, CAST(sum(live) OVER (ORDER BY epoch) AS BIGINT) AS live, CAST(sum(total) OVER (ORDER BY epoch) AS BIGINT) AS total FROM (SELECT epoch, count(*) AS n, sum(live) AS live, sum(total) AS total FROM segcount GROUP BY epoch)")
def f6(t):
    from pyspark.sql import Window

    per = t.segcount.groupBy("epoch").agg(F.count("*").alias("n"), F.sum("live").alias("live"), F.sum("total").alias("total"))
    run = Window.partitionBy(F.lit(0)).orderBy("epoch")  # a row for each epoch
    return per.select("epoch", F.sum("n").over(run).alias("segments"), F.sum("live").over(run).alias("live"), F.sum("total").over(run).alias("total"))


@query("f7_keys_by_kind", "SELECT * FROM (SELECT 'INODE' AS kind, CAST(count(*) AS BIGINT) AS keys FROM inode UNION ALL SELECT 'DIR_ENTRY', count(*) FROM dir_entry UNION ALL SELECT 'SEGCOUNT', count(*) FROM segcount UNION ALL SELECT 'EXTENT', count(*) FROM extent)")
def f7(t):
    from tidemark.functions import codec
    from tidemark.sources import storage

    rows = storage.key_space(t).groupBy(codec.kind_of(c("key")).alias("kind")).agg(F.count("*").alias("keys"))
    order = F.create_map(*[F.lit(x) for pair in codec.KINDS.items() for x in pair])
    return rows.orderBy(order[c("kind")])


@query("f8_referenced_bytes", "SELECT epoch, counter, CAST(sum(byte_len) AS BIGINT) AS referenced FROM extent GROUP BY epoch, counter")
def f8(t):
    return t.extent.groupBy("epoch", "counter").agg(F.sum("byte_len").alias("referenced"))


@query("f9_delete_horizon", "SELECT greatest(max(expires_at) + 30, 900000060) AS horizon, min(CASE WHEN expires_at IS NULL THEN created_at END) AS pinned_since FROM checkpoint")
def f9(t):
    return accounting.delete_horizon(t.checkpoint, 900_000_000)


@query("f10_pass_counters", "SELECT user_id % 50 AS worker, CAST(sum(length) AS BIGINT) AS moved, arg_max(length, event_id) AS last_length FROM access GROUP BY user_id % 50")
def f10(t):
    return t.access.groupBy((c("user_id") % 50).alias("worker")).agg(F.sum("length").alias("moved"), F.max_by("length", "event_id").alias("last_length"))


@query("f11_benchmark_summary", """SELECT benchmark, CAST(count(*) AS BIGINT) AS operations, count(CASE WHEN success THEN 1 END) AS succeeded, count(CASE WHEN NOT success THEN 1 END) AS failed, CAST(sum(CASE WHEN success THEN duration END) AS BIGINT) AS total_duration, min(CASE WHEN success THEN duration END) AS min_duration,
  max(CASE WHEN success THEN duration END) AS max_duration, round(avg(CASE WHEN success THEN duration END), 4) AS mean_duration, round(count(CASE WHEN success THEN 1 END) * 1e6::DOUBLE / sum(CASE WHEN success THEN duration END), 4) AS per_second, array_to_string(list_sort(list(DISTINCT error) FILTER (WHERE error IS NOT NULL)), ',') AS errors FROM bench_run GROUP BY benchmark""")
def f11(t):
    return accounting.benchmark_summary(t.bench_run)


@query("f12_metric_over_labels", "SELECT store, op, CAST(sum(duration_us) AS BIGINT) AS duration_us, CAST(sum(CASE WHEN error THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM object_access GROUP BY store, op")
def f12(t):
    return t.object_access.groupBy("store", "op").agg(F.sum("duration_us").alias("duration_us"), F.count_if("error").alias("errors"))


@query("f13_store_dead_percent", f"SELECT dead_percent FROM ({_FOOT})")
def f13(t):
    return accounting.footprint(t.segcount).select("dead_percent")


@query("f14_census_growth", "SELECT max(n) - min(n) AS inode_growth, max(b) - min(b) AS byte_growth FROM (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS b FROM inode WHERE inode_id <> 0 AND inode_id % 100 < 50 UNION ALL SELECT count(*), CAST(sum(size) AS BIGINT) FROM inode WHERE inode_id <> 0)")
def f14(t):
    rows = t.inode.where("inode_id <> 0")
    early = c("inode_id") % 100 < 50
    return rows.agg((F.count("*") - F.count_if(early)).alias("inode_growth"), (F.sum("size") - F.sum(F.when(early, c("size")))).alias("byte_growth"))


@query("f15_block_totals", "SELECT CAST(1000000000000 // 4096 AS BIGINT) AS blocks, CAST((1000000000000 - sum(used_bytes)) // 4096 AS BIGINT) AS free_blocks, CAST(4294967296 - sum(used_inodes) AS BIGINT) AS free_inodes FROM stats_shard")
def f15(t):
    one = t.stats_shard.agg(F.sum("used_bytes").alias("b"), F.sum("used_inodes").alias("n"))
    return one.selectExpr("1000000000000 div 4096 AS blocks", "(1000000000000 - b) div 4096 AS free_blocks", "4294967296 - n AS free_inodes")


@query("f16_dedup_occupancy", "SELECT CAST(count(*) AS BIGINT) AS entries, count(CASE WHEN n > 1 THEN 1 END) AS retried, count(CASE WHEN op_id = 0 THEN 1 END) AS exempt, CAST(max(n) AS BIGINT) AS most FROM (SELECT op_id, count(*) AS n FROM op_log GROUP BY op_id)")
def f16(t):
    per = t.op_log.groupBy("op_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("entries"), F.count_if(c("n") > 1).alias("retried"), F.count_if(c("op_id") == 0).alias("exempt"), F.max("n").alias("most"))
