"""Writers: merged batches, change logs, sealed segments, versions, exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.scan import latest


def scratch_root(spark: SparkSession) -> str:
    """The folder for what this application writes in between, which driver and executors share.

    It is below spark.checkpoint.dir; where that is unset below the warehouse, and on a single machine in its
    temporary folder.  The file system deletes it when the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            root = tempfile.gettempdir() if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
        _roots[app] = f"{root}/tidemark/{app}"
        place = spark._jvm.org.apache.hadoop.fs.Path(_roots[app])
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
    return _roots[app]


_roots: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below that of the application."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder and read it again."""
    path = scratch(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batch_write(changes: DataFrame, path: str, keys: list[str], order: list[str], log: str | None = None) -> None:
    """Write the state after a batch, the last write of a key winning; log: also write the changes."""
    latest(changes, keys, order).write.parquet(path)
    if log is not None:
        changes.write.partitionBy("epoch").parquet(log)


def seal(frames: DataFrame, path: str) -> None:
    """Write segments, a folder for each prefix and frames in order."""
    rows = frames.withColumn("prefix", F.col("counter").bitwiseAND(255))
    rows.repartition("prefix").sortWithinPartitions("prefix", "epoch", "counter", "frame_index").write.partitionBy("prefix").parquet(path)


def without(objects: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    return objects.join(gone.select(*on), on, "left_anti")


def missing(frames: DataFrame, objects: DataFrame) -> DataFrame:
    """Segments that have frames but no object, with the size they would have."""
    lost = frames.join(objects.select("epoch", "counter"), ["epoch", "counter"], "left_anti")
    return lost.groupBy("epoch", "counter").agg(F.sum("byte_len").alias("size"))


def flush(changes: DataFrame, path: str) -> DataFrame:
    """Write what is pending, then report the durable position of each epoch from what was written."""
    changes.select("epoch", "seqno", "op_index", "op", "key", "value").write.parquet(path)
    written = changes.sparkSession.read.parquet(path)
    return written.groupBy("epoch").agg(F.max("seqno").alias("durable_seqno"), F.countDistinct("seqno").alias("batches"))


def checkpoint_create(rows: DataFrame, path: str, name: str) -> None:
    rows.write.mode("errorifexists").parquet(f"{path}/version={name}")


def checkpoint_delete(spark: SparkSession, path: str, name: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={name}")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint_list(spark: SparkSession, path: str) -> DataFrame:
    """Versions and their entries; one without entries has files all the same, and counts 0."""
    rows = spark.read.schema("version string").parquet(path)
    counted = rows.select("version", F.lit(1).alias("n"))
    if rows.inputFiles():
        files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, version string").load(path)
        counted = counted.unionAll(files.select("version", F.lit(0).alias("n")))
    return counted.groupBy("version").agg(F.sum("n").alias("entries"))


def metrics(rows: DataFrame, time: str, names: dict[str, str]) -> DataFrame:
    """Counters and gauges as (time, metric, value)."""
    pairs = ", ".join(f"'{k}', {v}" for k, v in names.items())
    return rows.selectExpr(time, f"stack({len(names)}, {pairs}) AS (metric, value)")


def formats(rows: DataFrame, path: str) -> DataFrame:
    """Write a result as CSV, JSON and text, and read the three again."""
    spark, schema = rows.sparkSession, rows.schema
    rows.write.option("header", "true").csv(f"{path}/csv")
    rows.write.json(f"{path}/json")
    rows.select(F.concat_ws("\t", *rows.columns)).write.text(f"{path}/text")
    back = [
        spark.read.schema(schema).option("header", "true").csv(f"{path}/csv").withColumn("format", F.lit("csv")),
        spark.read.schema(schema).json(f"{path}/json").withColumn("format", F.lit("json")),
        spark.read.schema(schema).option("sep", "\t").csv(f"{path}/text").withColumn("format", F.lit("text")),
    ]
    return back[0].unionByName(back[1]).unionByName(back[2])


def report(rows: DataFrame, lines: dict[str, Column]) -> DataFrame:
    """Totals as lines of text with thousands separators."""
    one = rows.agg(*[v.cast("long").alias(f"c{k}") for k, v in enumerate(lines.values())])
    pairs = ", ".join(f"'{name}', format_number(c{k}, 0)" for k, name in enumerate(lines))
    return one.selectExpr(f"stack({len(lines)}, {pairs}) AS (line, text)")
