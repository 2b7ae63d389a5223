"""Change batches: merging, acceptance, replay, deduplication, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import running_max

c = F.col


def accepted_epochs(log: DataFrame) -> DataFrame:
    """Ops that are not of an epoch older than one already seen, in sequence order."""
    return running_max(log, ["seqno", "op_index"], c("epoch")).where("epoch >= top_").drop("top_")


def frontier(received: DataFrame, by: list[str], seq: str = "seqno") -> DataFrame:
    """The contiguous start of each log: first number, last number before the first gap, and how many numbers came in all."""
    once = received.select(*by, seq).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(seq))
    first = F.min(seq).over(Window.partitionBy(*by))
    rows = once.withColumn("gap_", c(seq) - first - rank + 1)
    return rows.groupBy(*by).agg(F.min(seq).alias("first"), F.max(F.when(c("gap_") == 0, c(seq))).alias("frontier"), F.count("*").alias("received"))


def contiguous(received: DataFrame, by: list[str], first: Column, last: Column, seq: str = "seqno") -> DataFrame:
    """Whether every number from first to last has been received."""
    inside = F.when(c(seq).between(first, last), c(seq))
    return received.groupBy(*by).agg((F.countDistinct(inside) == F.max(last - first + 1)).alias("whole"))


def replay_decision(stamp_epoch: Column, tail_epoch: Column, ran_solo: Column) -> Column:
    """What a node does with a replicated tail when it takes over."""
    return F.when(tail_epoch.isNull(), "nothing").when(tail_epoch < stamp_epoch, "discard_stale").when(ran_solo & (tail_epoch == stamp_epoch), "discard_solo").otherwise("replay")


def replay(log: DataFrame, after: int) -> DataFrame:
    """Ops past a durable position in sequence order."""
    return log.where(c("seqno") > after).orderBy("seqno", "op_index")


def first_results(ops: DataFrame, key: str, time: str, retention: int) -> DataFrame:
    """The role of each op: the first of its id runs; retries within the retention replay its result, later ones are rejected."""
    w = Window.partitionBy(key).orderBy(time, "event_id")
    first = F.first(time).over(w)
    n = F.row_number().over(w)
    role = F.when((c(key) == 0) | (n == 1), "execute").when(c(time) - first <= retention, "replay").otherwise("reject")
    return ops.withColumn("role", role)


def final_state(history: DataFrame) -> DataFrame:
    """Of each value: whether its last op that did not fail leaves it present, absent or unknown."""
    real = history.where("type <> 'fail'")
    last = real.groupBy("value").agg(F.max_by(F.struct("type", "f"), "seq").alias("last"))
    return last.select("value", F.when(c("last.type") == "info", "unknown").when(c("last.f") == "add", "present").otherwise("absent").alias("state"))


def set_audit(history: DataFrame, final: DataFrame) -> DataFrame:
    """Values lost (present, but not read) and resurrected (read and known, but neither present nor unknown)."""
    state = final_state(history)
    present, unknown = (state.where(c("state") == s).select("value") for s in ("present", "unknown"))
    lost = present.exceptAll(final).withColumn("verdict", F.lit("lost"))
    back = final.intersect(state.select("value")).exceptAll(present.unionAll(unknown).distinct().intersect(final)).withColumn("verdict", F.lit("resurrected"))
    return lost.unionAll(back)
