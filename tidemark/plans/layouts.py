"""Queries of layout, windows and orders (survey groups G and H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import heat, layout, liveness, policy, series
from tidemark.operators.accounting import classify
from tidemark.plans.registry import query

c = F.col

_RUN = """SELECT inode, run, min(extent) AS first_extent, max(extent) AS last_extent, min(epoch) AS epoch, min(counter) AS counter, min(byte_offset) AS byte_offset, CAST(sum(byte_len) AS BIGINT) AS byte_len FROM (
  SELECT *, CAST(sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY inode ORDER BY extent) AS BIGINT) AS run FROM (SELECT *, coalesce(extent = lag(extent) OVER w + 1 AND epoch = lag(epoch) OVER w AND counter = lag(counter) OVER w AND frame_index = lag(frame_index) OVER w + 1 AND byte_offset = lag(byte_offset) OVER w + lag(byte_len) OVER w, false) AS joined FROM extent WINDOW w AS (PARTITION BY inode ORDER BY extent))) GROUP BY inode, run"""


@query("g1_file_runs", _RUN)
def g1(t):
    return layout.file_runs(t.extent)


@query("g2_segment_runs", """SELECT epoch, counter, run, CAST(count(*) AS BIGINT) AS frames, min(byte_offset) AS byte_offset, CAST(sum(byte_len) AS BIGINT) AS byte_len FROM (SELECT *, CAST(sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY epoch, counter ORDER BY frame_index) AS BIGINT) AS run FROM (
  SELECT *, coalesce(frame_index = lag(frame_index) OVER w + 1 AND byte_offset = lag(byte_offset) OVER w + lag(byte_len) OVER w, false) AS joined FROM extent WINDOW w AS (PARTITION BY epoch, counter ORDER BY frame_index))) GROUP BY epoch, counter, run""")
def g2(t):
    return layout.segment_runs(t.extent)


@query("g3_seams", f"SELECT inode, last_extent AS extent, epoch AS epoch_a, counter AS counter_a, nb AS epoch_b, nc AS counter_b FROM (SELECT *, lead(first_extent) OVER w AS nx, lead(epoch) OVER w AS nb, lead(counter) OVER w AS nc FROM ({_RUN}) WINDOW w AS (PARTITION BY inode ORDER BY first_extent)) WHERE nx = last_extent + 1")
def g3(t):
    return layout.seams(layout.file_runs(t.extent))


_READS = """SELECT r.event_id, e.* FROM (SELECT event_id, inode, unnest(range("offset" // 32768, ("offset" + length - 1) // 32768 + 1)) AS extent FROM access WHERE operation = 'read') r JOIN extent e ON e.inode = r.inode AND e.extent = r.extent"""


@query("g4_nominations", f"""SELECT event_id, epoch, counter, fanout FROM (SELECT *, count(*) OVER (PARTITION BY event_id) AS fanout, row_number() OVER (PARTITION BY event_id ORDER BY first, epoch, counter) AS rank
  FROM (SELECT event_id, epoch, counter, min(extent) AS first FROM ({_READS}) GROUP BY ALL)) WHERE fanout >= 2 AND rank <= 16""")
def g4(t):
    touched = liveness.read_ranges(t.access.where("operation = 'read'"), t.extent).where("not hole")
    return layout.nominations(touched)


@query("g4_read_seams", f"""WITH p AS (SELECT *, epoch * 1000000000 + counter AS here, lag(epoch * 1000000000 + counter) OVER w AS there, lag(extent) OVER w AS pe, lag(frame_index) OVER w AS pf, lag(byte_offset + byte_len) OVER w AS po FROM ({_READS}) WINDOW w AS (PARTITION BY event_id, inode ORDER BY extent)),
  s AS (SELECT event_id, least(here, there) AS a, greatest(here, there) AS b, min(extent) AS extent FROM p WHERE extent = pe + 1 AND NOT (here = there AND frame_index = pf + 1 AND byte_offset = po) GROUP BY ALL)
  SELECT event_id, a // 1000000000 AS epoch_a, a % 1000000000 AS counter_a, b // 1000000000 AS epoch_b, b % 1000000000 AS counter_b, extent FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY extent, a, b) AS rank FROM s) WHERE rank <= 16""")
def g4_seams(t):
    touched = liveness.read_ranges(t.access.where("operation = 'read'"), t.extent, place=("frame_index", "byte_offset", "byte_len")).where("not hole")
    return layout.read_seams(touched)


@query("g5_batch_cuts")
def g5(t):
    return policy.batches(t.extent, target=4_000_000, slack=200_000, group_bytes=1 << 28)


@query("g6_final_sliver")
def g6(t):
    return policy.batches(t.extent, target=4_000_000, slack=200_000, sliver=3_000_000, group_bytes=1 << 28).groupBy("file_group", "batch").agg(F.count("*").alias("extents"), F.sum("byte_len").alias("bytes"))


_SCORED = "SELECT *, live * 1000 // greatest(total, 1) AS permille FROM segcount WHERE live > 0 AND (live * 2 < total OR total < 50000)"


@query("g7_budget_fill", f"SELECT epoch, counter, live, permille, place FROM (SELECT *, row_number() OVER w AS place, coalesce(sum(live) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_SCORED}) WINDOW w AS (ORDER BY permille, epoch, counter)) WHERE place <= 64 AND before < 300000")
def g7(t):
    rows = classify(t.segcount, small=50_000).where("class = 'candidate'")
    return layout.budget_fill(rows, 300_000, 64).select("epoch", "counter", "live", "permille", c("place").cast("long").alias("place"))


@query("g8_rate_series", "SELECT ts, rate FROM (SELECT ts, greatest(read_bytes - lag(read_bytes) OVER w, 0)::DOUBLE / (ts - lag(ts) OVER w) AS rate, row_number() OVER (ORDER BY ts DESC) AS rn FROM snapshot WINDOW w AS (ORDER BY ts)) WHERE rn <= 120")
def g8(t):
    rows = series.rates(t.snapshot, "ts", ["read_bytes"])
    return series.newest(rows, "ts", 120).select("ts", c("read_bytes_rate").alias("rate"))


@query("g9_chart_deltas", "SELECT ts, read_ops - lag(read_ops) OVER w AS reads, write_ops - lag(write_ops) OVER w AS writes FROM snapshot WINDOW w AS (ORDER BY ts) QUALIFY lag(ts) OVER w IS NOT NULL")
def g9(t):
    rows = series.rates(t.snapshot, "ts", ["read_ops", "write_ops"]).where("dt is not null")
    return rows.select("ts", F.round(c("read_ops_rate") * c("dt")).cast("long").alias("reads"), F.round(c("write_ops_rate") * c("dt")).cast("long").alias("writes"))


_HEAT = """WITH b AS (SELECT least(epoch_a * 10000 + counter_a, epoch_b * 10000 + counter_b) AS a, greatest(epoch_a * 10000 + counter_a, epoch_b * 10000 + counter_b) AS b, round, min(ts) AS first, max(ts) AS last FROM seam_event GROUP BY ALL), g AS (SELECT *, coalesce(first - lag(last) OVER w > 1800, true) AS fresh FROM b WINDOW w AS (PARTITION BY a, b ORDER BY round)),
  s AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY a, b ORDER BY round) AS episode FROM g) SELECT a // 10000 AS epoch_a, a % 10000 AS counter_a, b // 10000 AS epoch_b, b % 10000 AS counter_b, round, CAST(count(*) OVER (PARTITION BY a, b, episode ORDER BY round) AS BIGINT) AS heat, last AS last_seen FROM s"""


@query("g10_pair_heat", _HEAT)
def g10(t):
    return heat.pair_heat(t.seam_event)


@query("g11_read_ahead")
def g11(t):
    # fifty files, each read on where the last read stopped, but for every fifth read
    w = Window.partitionBy("inode").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    reads = t.access.where("operation = 'read'").withColumn("inode", c("user_id") % 50)
    reads = reads.withColumn("offset", F.when(c("event_id") % 5 == 0, c("offset")).otherwise(F.coalesce(F.sum("length").over(w), F.lit(0))))
    return policy.read_ahead(reads, window=1 << 16)


@query("g12_stream_tracker")
def g12(t):
    return policy.stream_tracker(t.object_access.join(t.access.select("event_id", "offset", "length"), "event_id").where("op = 'get'"))


@query("g13_contiguous_frontier", "SELECT epoch, min(seqno) AS first, max(CASE WHEN gap = 0 THEN seqno END) AS frontier, CAST(count(*) AS BIGINT) AS received FROM (SELECT epoch, seqno, seqno // 3 - min(seqno // 3) OVER (PARTITION BY epoch) - row_number() OVER (PARTITION BY epoch ORDER BY seqno) + 1 AS gap FROM (SELECT DISTINCT epoch, seqno FROM change WHERE seqno % 211 <> 100)) GROUP BY epoch".replace("min(seqno) AS first, max(CASE WHEN gap = 0 THEN seqno END)", "min(seqno // 3) AS first, max(CASE WHEN gap = 0 THEN seqno // 3 END)"))
def g13(t):
    from tidemark.operators.changelog import frontier

    return frontier(t.change.where("seqno % 211 <> 100").withColumn("seqno", F.floor(c("seqno") / 3)), ["epoch"])


@query("g14_range_contiguity", "SELECT epoch, count(DISTINCT CASE WHEN seqno // 3 BETWEEN 10 AND 60 THEN seqno // 3 END) = 51 AS whole FROM change GROUP BY epoch")
def g14(t):
    from tidemark.operators.changelog import contiguous

    return contiguous(t.change.withColumn("seqno", F.floor(c("seqno") / 3)), ["epoch"], F.lit(10), F.lit(60))


@query("g15_threshold_crossings", "SELECT ts, gauge FROM (SELECT ts, gauge, gauge >= 2 AS high, lag(gauge >= 2) OVER (ORDER BY ts) AS was FROM snapshot) WHERE high AND NOT coalesce(was, false)")
def g15(t):
    return series.crossings(t.snapshot, "ts", c("gauge") >= 2).select("ts", "gauge")


@query("g16_quiescence", "SELECT ts, ts - since AS unchanged_for, ts - since >= 300 AS quiet FROM (SELECT ts, max(CASE WHEN changed THEN ts END) OVER (ORDER BY ts) AS since FROM (SELECT ts, coalesce(write_ops <> lag(write_ops) OVER (ORDER BY ts), true) AS changed FROM snapshot))")
def g16(t):
    return series.quiescent(t.snapshot, "ts", "write_ops", 300).select("ts", "unchanged_for", "quiet")


@query("g17_last_op_decides", "SELECT value, CASE WHEN arg_max(type, seq) = 'info' THEN 'unknown' WHEN arg_max(f, seq) = 'add' THEN 'present' ELSE 'absent' END AS state FROM history WHERE type <> 'fail' GROUP BY value")
def g17(t):
    from tidemark.operators.changelog import final_state

    return final_state(t.history)


@query("h1_fragmentation_order", f"SELECT epoch, counter, permille FROM ({_SCORED}) ORDER BY permille, epoch, counter LIMIT 500")
def h1(t):
    return layout.ranked(classify(t.segcount, small=50_000).where("class = 'candidate'"), 500).select("epoch", "counter", "permille")


@query("h2_candidate_buffer", f"SELECT epoch, counter, permille, counter % 13 = 0 AS nominated FROM ({_SCORED}) ORDER BY counter % 13 <> 0, permille, epoch, counter LIMIT 4096")
def h2(t):
    rows = classify(t.segcount, small=50_000).where("class = 'candidate'").withColumn("nominated", c("counter") % 13 == 0)
    return rows.orderBy(F.desc("nominated"), "permille", "epoch", "counter").limit(4096).select("epoch", "counter", "permille", "nominated")


_TAIL = "SELECT *, live * 1000 // greatest(total, 1) AS permille FROM segcount WHERE live * 2 >= total AND total >= 50000 AND (total - live) * 100 > total * 5"


@query("h3_tail_buffer", f"SELECT epoch, counter, permille FROM ({_TAIL}) ORDER BY permille, epoch, counter LIMIT 1000")
def h3(t):
    return layout.ranked(classify(t.segcount, small=50_000, floor_percent=5).where("class = 'tail'"), 1000).select("epoch", "counter", "permille")


@query("h4_tail_order", f"SELECT epoch, counter, permille, row_number() OVER (PARTITION BY epoch ORDER BY permille, counter) AS place FROM ({_TAIL})")
def h4(t):
    rows = classify(t.segcount, small=50_000, floor_percent=5).where("class = 'tail'")
    return rows.select("epoch", "counter", "permille", F.row_number().over(Window.partitionBy("epoch").orderBy("permille", "counter")).cast("long").alias("place"))


@query("h5_round_caps", "SELECT epoch, counter, total FROM segcount WHERE live = 0 ORDER BY epoch, counter LIMIT 1024")
def h5(t):
    return t.segcount.where("live = 0").orderBy("epoch", "counter").limit(1024).select("epoch", "counter", "total")


@query("h7_repack_order", "SELECT inode, extent, byte_len FROM extent WHERE epoch = 1997")
def h7(t):
    return layout.repack_order(t.extent.where("epoch = 1997")).select("inode", "extent", "byte_len")


@query("h10_bounded_first_seen", "SELECT counter_a, counter_b, min(event_id) AS first_seen FROM seam_event GROUP BY counter_a, counter_b ORDER BY first_seen DESC, counter_a, counter_b LIMIT 100")
def h10(t):
    return layout.first_seen(t.seam_event, ["counter_a", "counter_b"], "event_id", 100)


@query("h11_tombstone_round", """SELECT ts, inode_id, n AS extents, least(n, 2000 - before) AS taken, CASE WHEN least(n, 2000 - before) = n THEN 0 ELSE least((n - (2000 - before)) * 32768, remaining_size) END AS remaining_after FROM (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY ts, inode_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (
  SELECT *, (remaining_size + 32767) // 32768 AS n FROM tombstone ORDER BY ts, inode_id LIMIT 10000)) WHERE before < 2000 OR n = 0 AND before <= 2000""")
def h11(t):
    return layout.tombstone_round(t.tombstone, 2000, 10_000)
