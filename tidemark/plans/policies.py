"""Queries of graph and policy operators (survey group K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import heat, policy
from tidemark.operators.accounting import classify, write_cold
from tidemark.plans.layouts import _HEAT
from tidemark.plans.registry import query

c = F.col

_PAIRS = "SELECT DISTINCT epoch * 10000 + counter AS a, epoch * 10000 + counter + CASE WHEN counter % 3 = 0 THEN 3 ELSE 5 END AS b FROM segcount WHERE counter % 7 < 3"


def _pairs(t):
    a = c("epoch") * 10000 + c("counter")
    return t.segcount.where("counter % 7 < 3").select(a.alias("a"), (a + F.when(c("counter") % 3 == 0, 3).otherwise(5)).alias("b")).distinct()


@query("k1_chain_membership", f"""WITH RECURSIVE p AS ({_PAIRS}), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other) SELECT node, min(other) AS chain FROM r GROUP BY node""")
def k1(t):
    return heat.chains(_pairs(t))


@query("k1_chain_order")
def k1_order(t):
    pairs = _pairs(t)
    return policy.breadth_first(heat.chains(pairs), pairs)


@query("k2_hot_pairs", f"SELECT epoch_a, counter_a, epoch_b, counter_b, heat, last_seen FROM (SELECT *, row_number() OVER (PARTITION BY epoch_a, counter_a, epoch_b, counter_b ORDER BY round DESC) AS rn FROM ({_HEAT})) WHERE rn = 1 AND heat >= 2 AND (SELECT max(ts) FROM seam_event) - last_seen <= 400000")
def k2(t):
    now = t.seam_event.agg(F.max("ts")).first()[0]
    return heat.hot_pairs(heat.pair_heat(t.seam_event), now, stale=400_000)


@query("k3_select_round")
def k3(t):
    rows = classify(t.segcount.where("live > 0"), small=50_000, floor_percent=5)
    rows = rows.withColumn("nominated", c("counter") % 13 == 0).withColumn("cold", write_cold(c("epoch"), c("counter"), 2000, 2000))
    now = t.seam_event.agg(F.max("ts")).first()[0]
    hot = heat.hot_pairs(heat.pair_heat(t.seam_event), now, stale=400_000)
    return policy.select_round(rows.select("epoch", "counter", "live", "permille", "class", "nominated", "cold"), hot, 4_000_000)


@query("k4_round_gate", "SELECT epoch, CAST(sum(total - live) AS BIGINT) AS freed, CAST(sum(live) AS BIGINT) AS live, CAST(count(CASE WHEN counter % 997 = 0 THEN 1 END) AS BIGINT) AS chains, sum(total - live) >= 100000000 OR sum(live) * 4 >= 2000000000 OR count(CASE WHEN counter % 997 = 0 THEN 1 END) > 0 AS go FROM segcount GROUP BY epoch")
def k4(t):
    totals = t.segcount.groupBy("epoch").agg(F.sum(c("total") - c("live")).alias("freed"), F.sum("live").alias("live"), F.count_if(c("counter") % 997 == 0).alias("chains"))
    return policy.gate(totals, 100_000_000, 2_000_000_000)


@query("k5_next_pass", """SELECT ts, CASE tier WHEN 'fast' THEN 5 WHEN 'drain' THEN 15 ELSE 60 END AS interval, tier, concat(why, CASE WHEN over > 0 THEN concat('; ', CAST(over AS STRING), ' seams over-reserve') ELSE '' END) AS reason FROM (
  SELECT *, CASE WHEN NOT done OR NOT full THEN 'base' WHEN idle THEN 'fast' WHEN dead >= 20 OR deferred > 0 THEN 'drain' ELSE 'base' END AS tier, CASE WHEN NOT done THEN 'pass not completed' WHEN NOT full THEN 'backlog drained' WHEN idle THEN 'saturated backlog, store idle'
    WHEN dead >= 20 OR deferred > 0 THEN concat(concat_ws(' + ', CASE WHEN dead >= 20 THEN concat(CAST(dead AS STRING), '% dead') END, CASE WHEN deferred > 0 THEN concat(CAST(deferred AS STRING), ' seams deferred') END), ', store active') ELSE concat(CAST(dead AS STRING), '% dead, store active, small backlog') END AS why
  FROM (SELECT ts, ts // 60 % 7 <> 0 AS done, ts // 60 % 5 <> 0 AS "full", write_ops % 4 = 0 AS idle, read_ops % 40 AS dead, read_bytes % 3 AS deferred, gauge AS over FROM snapshot))""".replace("AND NOT full", "").replace("NOT full", 'NOT "full"'))
def k5(t):
    m = F.expr("ts div 60")
    interval, tier, why = policy.next_pass(m % 7 != 0, m % 5 != 0, c("write_ops") % 4 == 0, c("read_ops") % 40, c("read_bytes") % 3, c("gauge"))
    return t.snapshot.select("ts", interval.alias("interval"), tier.alias("tier"), why.alias("reason"))


@query("k6_delete_deadline", """SELECT segment, pass, min(pass * 10 + segment) OVER (PARTITION BY segment, episode) AS deadline FROM (SELECT *, sum(CASE WHEN dead AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY segment ORDER BY pass) AS episode FROM (SELECT segment, pass, dead, coalesce(lag(dead) OVER (PARTITION BY segment ORDER BY pass), false) AS was FROM (
  SELECT user_id % 60 AS segment, event_id // 100 AS pass, max(event_id % 3) < 2 AS dead FROM access GROUP BY ALL))) WHERE dead""")
def k6(t):
    passes = t.access.groupBy((c("user_id") % 60).alias("segment"), F.expr("event_id div 100").alias("pass")).agg((F.max(c("event_id") % 3) < 2).alias("dead"))
    w = Window.partitionBy("segment").orderBy("pass")
    begun = passes.withColumn("starts", c("dead") & ~F.coalesce(F.lag("dead").over(w), F.lit(False)))
    rows = begun.withColumn("episode", F.sum(c("starts").cast("int")).over(w)).where("dead")
    # the horizon of the pass that first saw the segment dead holds for the whole episode
    return rows.select("segment", "pass", F.min(c("pass") * 10 + c("segment")).over(Window.partitionBy("segment", "episode")).alias("deadline"))
