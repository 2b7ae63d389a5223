"""Space accounting of segments: deltas, totals, classes, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.attributes import I64_MAX, dead_percent, live_permille

c = F.col


def segment_counts(frames: DataFrame, live: str = "live") -> DataFrame:
    """(epoch, counter, total, live) from frames with a flag of those still referenced."""
    return frames.groupBy("epoch", "counter").agg(F.sum("byte_len").alias("total"), F.sum(F.when(c(live), c("byte_len")).otherwise(0)).alias("live"))


def write_cold(epoch: Column, counter: Column, now_epoch: int, now_counter: int, behind: int = 30, quiescent: bool = False) -> Column:
    """Not likely to be written again: of another epoch, or well behind the newest counter."""
    return F.lit(quiescent) | (epoch != now_epoch) | (F.greatest(F.lit(now_counter) - counter, F.lit(0)) >= behind)


def classify(segments: DataFrame, small: int = 1 << 20, floor_percent: int = 5, fragmented_percent: int = 50) -> DataFrame:
    """Dead, candidate (fragmented or small), tail (some dead space) or keep; the first that fits."""
    dead = (c("total") - c("live")) * 100 > c("total") * floor_percent
    fragmented = c("live") * 100 < c("total") * fragmented_percent
    kind = F.when(c("live") == 0, "dead").when(fragmented | (c("total") < small), "candidate").when(dead, "tail").otherwise("keep")
    return segments.withColumn("class", kind).withColumn("permille", live_permille(c("live"), c("total")))


def footprint(segments: DataFrame) -> DataFrame:
    """Segments, live and total bytes, bytes that could be reclaimed, and percent dead."""
    one = segments.agg(F.count("*").alias("segments"), F.coalesce(F.sum("live"), F.lit(0)).alias("live"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    return one.withColumn("reclaimable", c("total") - c("live")).withColumn("dead_percent", dead_percent(c("live"), c("total")))


def clamped_sum(value: Column) -> Column:
    """A sum that stops at the 64-bit bounds instead of failing."""
    wide = F.sum(value.cast("decimal(38,0)"))
    bound = lambda x: F.lit(x).cast("decimal(38,0)")
    return F.greatest(F.least(wide, bound(I64_MAX)), bound(-I64_MAX)).cast("long")


def shard_deltas(deltas: DataFrame, shards: int = 100) -> DataFrame:
    """(shard_id, bytes, inodes): saturating sums of signed deltas per shard of the inode."""
    return deltas.groupBy(F.pmod("inode_id", F.lit(shards)).alias("shard_id")).agg(clamped_sum(c("bytes")).alias("bytes"), clamped_sum(c("inodes")).alias("inodes"))


def apply_deltas(base: DataFrame, deltas: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    """Absolute values after deltas, not below 0; values: column of base to column of deltas."""
    both = base.join(deltas, key, "full")
    return both.select(key, *[F.greatest(F.coalesce(c(k), F.lit(0)).cast("decimal(38,0)") + F.coalesce(c(d), F.lit(0)), F.lit(0)).cast("long").alias(k) for k, d in values.items()])


def segment_deltas(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counters after a batch: live not below 0, total never falling; fresh: the segment was not counted before."""
    batch = deltas.groupBy("epoch", "counter").agg(clamped_sum(c("d_live")).alias("d_live"), clamped_sum(c("d_total")).alias("d_total"))
    both = base.join(batch, ["epoch", "counter"], "full")
    had, zero = F.coalesce(c("total"), F.lit(0)), F.lit(0)
    grown = F.greatest(had, had + F.coalesce(c("d_total"), zero))
    return both.select("epoch", "counter", F.greatest(F.coalesce(c("live"), zero) + F.coalesce(c("d_live"), zero), zero).alias("live"), grown.alias("total"), ((had == 0) & (grown > 0)).alias("fresh"))


def reconcile(counters: DataFrame, referenced: DataFrame) -> DataFrame:
    """Counters against the bytes that the forward map refers to: only what disagrees, with its kind."""
    both = counters.select("epoch", "counter", c("live").alias("counted"), "total").join(referenced.select("epoch", "counter", "referenced"), ["epoch", "counter"], "full")
    kind = F.when(c("counted").isNull(), "missing_counter").when(F.coalesce(c("referenced"), F.lit(0)) != c("counted"), "wrong_live").when(c("counted") > c("total"), "live_over_total")
    return both.withColumn("violation", kind).where("violation is not null").select("epoch", "counter", "counted", "referenced", "violation")


def without_no_ops(deltas: DataFrame, columns: list[str]) -> DataFrame:
    """Deltas in which at least one column is not 0."""
    some = F.lit(False)
    for k in columns:
        some = some | (c(k) != 0)
    return deltas.where(some)


def delete_horizon(checkpoints: DataFrame, now: int, slack: int = 30, least: int = 60) -> DataFrame:
    """When dead segments may go: past the last expiry plus slack, not before now + least; and the oldest pin that never expires."""
    return checkpoints.agg(
        F.greatest(F.coalesce(F.max("expires_at") + slack, F.lit(0)), F.lit(now + least).cast("long")).alias("horizon"),
        F.min(F.when(c("expires_at").isNull(), c("created_at"))).alias("pinned_since"),
    )


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """Counts, durations and rate of successful runs, and the distinct errors, per benchmark."""
    good = lambda f: f(F.when(c("success"), c("duration")))
    return runs.groupBy("benchmark").agg(
        F.count("*").alias("operations"), F.count_if(c("success")).alias("succeeded"), F.count_if(~c("success")).alias("failed"), good(F.sum).alias("total_duration"), good(F.min).alias("min_duration"), good(F.max).alias("max_duration"),
        F.round(good(F.avg), 4).alias("mean_duration"), F.round(F.count_if(c("success")) * 1e6 / good(F.sum), 4).alias("per_second"), F.array_join(F.sort_array(F.collect_set("error")), ",").alias("errors"),
    )
