"""Queries of streams and stateful semantics (survey groups A17 to A19 and L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import changelog, scan
from tidemark.plans.registry import query
from tidemark.streaming import streams

c = F.col


def _access(t):
    return streams.access_events(streams.table_stream(t.spark, t.sf_dir, "events"))


@query("a17_access_stream", "SELECT ts // 300 * 300 AS start, operation, CAST(count(*) AS BIGINT) AS events, CAST(sum(length) AS BIGINT) AS bytes FROM access GROUP BY ALL")
def a17(t):
    return streams.updated(streams.windowed(_access(t), "5 minutes", ["operation"]), ["start", "operation"])


@query("a18_object_stream", "SELECT CASE event_id % 3 WHEN 0 THEN 'data' WHEN 1 THEN 'wal' ELSE 'meta' END AS store, operation, CAST(count(*) AS BIGINT) AS events, CAST(sum(length * 3) AS BIGINT) AS duration_us, count(CASE WHEN event_id % 29 = 0 THEN 1 END) AS errors FROM access GROUP BY ALL")
def a18(t):
    rows = streams.object_events(_access(t)).groupBy("store", "operation")
    return streams.updated(rows.agg(F.count("*").alias("events"), F.sum("duration_us").alias("duration_us"), F.count_if("error").alias("errors")), ["store", "operation"])


@query("a19_stats_sampler", "SELECT ts // 60 * 60 AS start, CAST(count(*) AS BIGINT) AS events, CAST(sum(length) AS BIGINT) AS bytes FROM access GROUP BY ALL")
def a19(t):
    return streams.updated(streams.windowed(_access(t), "1 minute", []), ["start"])


@query("l1_lossless_events", "SELECT event_id, operation, length FROM access")
def l1(t):
    return streams.appended(_access(t).select("event_id", "operation", "length"))


@query("l2_events_with_paths", "SELECT event_id, operation, c_name AS path FROM access LEFT JOIN customer ON c_custkey = user_id")
def l2(t):
    paths = t.customer.select(c("c_custkey").alias("user_id"), c("c_name").alias("path"))
    return streams.appended(streams.with_paths(_access(t), paths).select("event_id", "operation", "path"))


@query("l3_event_order", "SELECT ts, event_id, row_number() OVER (PARTITION BY ts // 3600 ORDER BY ts, event_id) AS place FROM access")
def l3(t):
    from pyspark.sql import Window

    got = streams.appended(_access(t).select("event_id", F.unix_seconds("time").alias("ts")))
    return got.select("ts", "event_id", F.row_number().over(Window.partitionBy(F.expr("ts div 3600")).orderBy("ts", "event_id")).cast("long").alias("place"))


@query("l4_exactly_once")
def l4(t):
    """Ops of the stream that run: the first of each id within 150 seconds of event time."""
    ops = _access(t).withColumn("op_id", c("event_id") % 2000)
    return streams.appended(streams.once(ops, "op_id", "150 seconds").select("op_id", "event_id"))


@query("l5_rejected_retries", "SELECT op_id, event_id, CASE WHEN op_id = 0 OR rn = 1 THEN 'execute' WHEN ts - first <= 150 THEN 'replay' ELSE 'reject' END AS role FROM (SELECT *, row_number() OVER w AS rn, first_value(ts) OVER w AS first FROM op_log WINDOW w AS (PARTITION BY op_id ORDER BY ts, event_id))")
def l5(t):
    return changelog.first_results(t.op_log, "op_id", "ts", 150).select("op_id", "event_id", "role")


_LAST = "SELECT key, op, value, seqno FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seqno DESC, op_index DESC, epoch DESC, op DESC, value DESC) AS rn FROM change WHERE seqno <= {}) WHERE rn = 1"


@query("l6_durable_view", f"SELECT v.key, CASE WHEN v.op <> 'delete' THEN v.value END AS value, v.seqno <= 800 AS durable, CASE WHEN d.op <> 'delete' THEN d.value END AS durable_value FROM ({_LAST.format(1 << 60)}) v LEFT JOIN ({_LAST.format(800)}) d ON d.key = v.key WHERE v.op <> 'delete' OR d.op <> 'delete'")
def l6(t):
    return scan.views(t.change, "key", ["seqno", "op_index", "epoch", "op", "value"], 800)


@query("l7_sessions", "SELECT user_id, min(ts) AS start, max(ts) + 1800 AS stop, CAST(count(*) AS BIGINT) AS events FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 1800, true) AS gap FROM access)) GROUP BY user_id, s")
def l7(t):
    return streams.complete(streams.sessions(_access(t), "30 minutes", ["user_id"]))


@query("l8_periodic_ticks", "SELECT ts // 60 AS tick, ts // 60 % 60 = 0 AS hourly, CAST(count(*) AS BIGINT) AS events FROM access GROUP BY ALL")
def l8(t):
    """Work due at each tick of a minute, and at every sixtieth; the stream is looked at on a timer."""
    got = streams.ticking(_access(t).select(F.unix_seconds("time").alias("ts")), "1 second")
    rows = got.groupBy(F.expr("ts div 60").alias("tick")).agg(F.count("*").alias("events"))
    return rows.select("tick", (c("tick") % 60 == 0).alias("hourly"), "events")


@query("l9_coalesced_commits", "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seqno DESC) AS rn FROM (SELECT user_id % 500 AS key, event_id AS seqno, length AS value, operation FROM access)) WHERE rn = 1 AND operation <> 'remove'")
def l9(t):
    rows = _access(t).select((c("user_id") % 500).alias("key"), c("event_id").alias("seqno"), c("length").alias("value"), F.when(c("operation") == "remove", "delete").otherwise("put").alias("op"))
    return streams.merged(rows, ["key"], ["seqno"]).select("key", "value")


@query("l10_sliding_windows", "SELECT start, CAST(count(*) AS BIGINT) AS events, CAST(sum(length) AS BIGINT) AS bytes FROM (SELECT length, unnest(range(ts // 300 * 300 - 300, ts // 300 * 300 + 1, 300)) AS start FROM access) GROUP BY start")
def l10(t):
    return streams.updated(streams.windowed(_access(t), "10 minutes", [], slide="5 minutes"), ["start"])


@query("l10_stream_join", "SELECT a.event_id AS a_id, b.event_id AS b_id FROM access a JOIN access b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + 3600 WHERE a.operation = 'lookup' AND b.operation = 'write'")
def l10_join(t):
    return streams.appended(streams.matched(_access(t).where("operation = 'lookup'"), _access(t).where("operation = 'write'"), 3600))
