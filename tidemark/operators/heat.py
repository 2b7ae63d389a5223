"""Heat of segment pairs that reads cross together, and the chains they form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.sources.sinks import kept

c = F.col
STALE = 1800


SEAM = ["epoch_a", "counter_a", "epoch_b", "counter_b"]


def pair_heat(events: DataFrame, stale: int = STALE) -> DataFrame:
    """(segment a, segment b, round, heat, last_seen): rounds in which a pair was seen, counted anew after a long gap.

    A segment is its epoch and counter.  A pair has no order and counts once for a round; the gap is
    from the last sight to the next round's first.
    """
    one, other = F.struct(c("epoch_a").alias("epoch"), c("counter_a").alias("counter")), F.struct(c("epoch_b").alias("epoch"), c("counter_b").alias("counter"))
    pairs = events.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b"), "round", "ts")
    pairs = pairs.select(c("a.epoch").alias("epoch_a"), c("a.counter").alias("counter_a"), c("b.epoch").alias("epoch_b"), c("b.counter").alias("counter_b"), "round", "ts")
    seen = pairs.groupBy(*SEAM, "round").agg(F.min("ts").alias("first"), F.max("ts").alias("last_seen"))
    w = Window.partitionBy(*SEAM).orderBy("round")
    fresh = F.coalesce(c("first") - F.lag("last_seen").over(w) > stale, F.lit(True))
    rows = seen.withColumn("fresh", fresh).withColumn("episode", F.sum(c("fresh").cast("int")).over(w))
    return rows.select(*SEAM, "round", F.count("*").over(Window.partitionBy(*SEAM, "episode").orderBy("round")).alias("heat"), "last_seen")


def hot_pairs(heat: DataFrame, now: int, least: int = 2, stale: int = STALE) -> DataFrame:
    """Pairs that are hot now: seen in enough rounds and not stale, in order."""
    last = heat.groupBy(*SEAM).agg(F.max_by(F.struct("heat", "last_seen"), "round").alias("x"))
    return last.select(*SEAM, "x.heat", "x.last_seen").where((c("heat") >= least) & (F.lit(now) - c("last_seen") <= stale)).orderBy(*SEAM)


def chains(pairs: DataFrame) -> DataFrame:
    """(node, chain): connected components of pairs by the smallest node.

    Labels are lowered along pairs and along themselves, and written after every round
    to the shared folder, until none changes.
    """
    links = kept(pairs.select("a", "b").unionAll(pairs.select(c("b").alias("a"), c("a").alias("b"))).distinct())
    labels = kept(links.groupBy(c("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("chain")))
    while True:
        near = links.join(labels, links.b == labels.node).groupBy(c("a").alias("node")).agg(F.min("chain").alias("near"))
        lower = labels.join(near, "node").select("node", "chain", F.least("chain", "near").alias("low"))
        jump = labels.select(c("node").alias("low"), c("chain").alias("jump"))
        moved = Observation()
        after = lower.join(jump, "low", "left").select("node", F.least("low", "jump").alias("new"), "chain").observe(moved, F.count_if(c("new") < c("chain")).alias("n"))
        labels = kept(after.select("node", c("new").alias("chain")))
        if not moved.get["n"]:
            return labels
