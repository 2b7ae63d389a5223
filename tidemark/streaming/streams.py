"""Event streams: sources, windowed and stateful operators, and runs to completion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import latest
from tidemark.sources.sinks import scratch

c = F.col


def table_stream(spark: SparkSession, folder: str, name: str, files: int = 1) -> DataFrame:
    """A table's files as a stream; new files become new micro-batches."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files).parquet(folder)


def _seconds(column: str):
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"CAST(timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column}) AS BIGINT)")


def access_events(events: DataFrame) -> DataFrame:
    """File accesses with an event time; times have whole seconds, event_id breaks ties."""
    kind = F.when(c("event_type") == "click", "read").when(c("event_type") == "view", "lookup").when(c("event_type") == "purchase", "write").when(c("event_type") == "signup", "create").otherwise("remove")
    return events.select("event_id", F.timestamp_seconds(_seconds("ts")).alias("time"), "user_id", kind.alias("operation"), (F.floor(F.abs("value")) * 100 + 1).alias("length"))


def object_events(access: DataFrame) -> DataFrame:
    """Object-store accesses that the file accesses cause."""
    store = F.when(c("event_id") % 3 == 0, "data").when(c("event_id") % 3 == 1, "wal").otherwise("meta")
    return access.select("event_id", "time", store.alias("store"), "operation", (c("length") * 3).alias("duration_us"), (c("event_id") % 29 == 0).alias("error"))


def windowed(access: DataFrame, width: str, by: list[str], slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and bytes per time window; state is dropped once the watermark has passed it."""
    span = F.window("time", width, slide) if slide else F.window("time", width)
    out = access.withWatermark("time", late).groupBy(span.alias("w"), *by).agg(F.count("*").alias("events"), F.sum("length").alias("bytes"))
    return out.select(F.unix_seconds("w.start").alias("start"), *by, "events", "bytes")


def sessions(access: DataFrame, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """Runs of events less than a gap apart; a run stops a gap after its last event.

    Spark joins windows that touch, so they are shorter by a microsecond, the unit of time. late: drop events that
    come later than this (append mode needs it); without it none is lost, whatever the order of micro-batches.
    """
    timed = access.withWatermark("time", late) if late else access
    out = timed.groupBy(F.session_window("time", f"{gap} -1 microsecond").alias("w"), *by).agg(F.count("*").alias("events"))
    return out.select(*by, F.unix_seconds("w.start").alias("start"), F.unix_seconds(F.expr("w.end + INTERVAL 1 MICROSECOND")).alias("stop"), "events")


def once(ops: DataFrame, key: str, retention: str) -> DataFrame:
    """The ops that run: the first of each id within the retention, and all with the id 0, which is exempt."""
    ops = ops.withWatermark("time", retention)
    return ops.where(c(key) != 0).dropDuplicatesWithinWatermark([key]).unionByName(ops.where(c(key) == 0))


def with_paths(access: DataFrame, paths: DataFrame) -> DataFrame:
    """Events joined with a static table of resolved paths."""
    return access.join(paths, "user_id", "left")


def matched(left: DataFrame, right: DataFrame, seconds: int) -> DataFrame:
    """Events of two streams of one user that are at most so far apart."""
    a = left.select(c("event_id").alias("a_id"), c("user_id").alias("a_user"), c("time").alias("a_time")).withWatermark("a_time", "10 minutes")
    b = right.select(c("event_id").alias("b_id"), c("user_id").alias("b_user"), c("time").alias("b_time")).withWatermark("b_time", "10 minutes")
    near = F.expr(f"a_user = b_user AND b_time >= a_time AND b_time <= a_time + interval {seconds} seconds")
    return a.join(b, near).select("a_id", "b_id")


def _run(spark: SparkSession, start: Callable, partitions: int = 8) -> None:
    """Start a query with few state partitions (these streams are small), and wait until the input is used up."""
    key = "spark.sql.shuffle.partitions"
    had = spark.conf.get(key)
    spark.conf.set(key, min(int(had), partitions))
    try:
        running = start()
    finally:
        spark.conf.set(key, had)
    running.awaitTermination()


def _written(rows: DataFrame, mode: str) -> DataFrame:
    """What each micro-batch of a query gives, as Parquet rows with its number (``batch_``)."""
    spark, place = rows.sparkSession, scratch(rows.sparkSession, "stream")
    schema = f"{rows._jdf.schema().toDDL()}, batch_ long"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{place}/rows/part={number}")

    spark.createDataFrame([], schema).write.parquet(f"{place}/rows/part=-1")
    _run(spark, lambda: rows.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start())
    return spark.read.schema(schema).parquet(f"{place}/rows/part=*")


def updated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The result of a streaming aggregation over all input that there is now: the last update of each key.

    Updates go to files; state is dropped once the watermark has passed it.
    """
    rest = [k for k in rows.columns if k not in keys]
    got = _written(rows, "update")
    if not keys:
        return got.agg(F.max_by(F.struct(*rest), "batch_").alias("x")).select("x.*")
    return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_").alias("x")).select(*keys, "x.*").select(*rows.columns)


def complete(rows: DataFrame) -> DataFrame:
    """The same for aggregations that have no updates (session windows): the files of the last micro-batch.

    Their state stays until the query ends.
    """
    got = _written(rows, "complete")
    return got.join(F.broadcast(got.agg(F.max("batch_").alias("batch_"))), "batch_").select(*rows.columns)


def ticking(rows: DataFrame, every: str) -> DataFrame:
    """Rows of a stream that is looked at on a processing-time trigger, with the tick at which they came."""
    spark, place = rows.sparkSession, scratch(rows.sparkSession, "ticks")
    schema = f"{rows._jdf.schema().toDDL()}, tick_ long"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("tick_", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{place}/rows/part={number}")

    spark.createDataFrame([], schema).write.parquet(f"{place}/rows/part=-1")
    running = rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{place}/log").trigger(processingTime=every).start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema(schema).parquet(f"{place}/rows/part=*")


def appended(rows: DataFrame) -> DataFrame:
    """What a stream appends to a Parquet table (exactly once), read again."""
    spark, place = rows.sparkSession, scratch(rows.sparkSession, "appended")
    _run(spark, lambda: rows.writeStream.outputMode("append").format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start())
    return spark.read.schema(rows.schema).parquet(f"{place}/rows")


def merged(changes: DataFrame, keys: list[str], order: list[str], buckets: int = 16) -> DataFrame:
    """State after all micro-batches of a change stream, each coalesced to its last writes and merged into a new version.

    The state lies in ``buckets`` of keys; a micro-batch reads and rewrites those that it touches.
    """
    spark, place = changes.sparkSession, scratch(changes.sparkSession, "merged")
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(k) for k in order]))
    last: dict[int, str] = {}

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("bucket_", F.pmod(F.hash(*keys), F.lit(buckets)))
        touched = [r.bucket_ for r in batch.select("bucket_").distinct().collect()]
        before = [last[b] for b in touched if b in last]
        rows = batch.unionByName(spark.read.schema(batch.drop("bucket_").schema).parquet(*before).withColumn("bucket_", F.pmod(F.hash(*keys), F.lit(buckets)))) if before else batch
        rows.withColumn("rn_", newest).where("rn_ = 1").drop("rn_").write.mode("overwrite").partitionBy("bucket_").parquet(f"{place}/version={number}")
        last.update({b: f"{place}/version={number}/bucket_={b}" for b in touched})

    _run(spark, lambda: changes.writeStream.foreachBatch(merge).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start())
    if not last:
        return spark.createDataFrame([], changes.schema)
    return latest(spark.read.schema(changes.schema).parquet(*sorted(set(last.values()))), keys, order)
