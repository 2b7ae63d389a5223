"""Segment objects, checkpoints and the raw key space as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec

# URL schemes and the store that serves each.
SCHEMES = {"file": "file", "memory": "memory", "s3": "s3", "s3a": "s3", "gs": "gs", "az": "azure", "adl": "azure", "azure": "azure", "abfs": "azure", "abfss": "azure", "http": "http", "https": "http"}


def scheme(url: Column) -> Column:
    """The kind of store of a URL; NULL for schemes that are not known."""
    stores = F.create_map(*[F.lit(x) for pair in SCHEMES.items() for x in pair])
    return F.try_element_at(stores, F.lower(F.regexp_extract(url, "^([A-Za-z0-9+.-]+):", 1)))


def key_space(t) -> DataFrame:
    """Raw keys of several kinds, as one ordered map would hold them."""
    c = F.col
    parts = [
        t.inode.select(codec.key("INODE", c("inode_id")).alias("key")),
        t.extent.select(codec.key("EXTENT", c("inode"), c("extent")).alias("key")),
        t.segcount.select(codec.key("SEGCOUNT", c("epoch"), c("counter")).alias("key")),
        t.dir_entry.select(codec.key("DIR_ENTRY", c("dir_id"), name=c("name")).alias("key")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder of any store that Spark reads: path, size, time of change."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def by_prefix(objects: DataFrame) -> DataFrame:
    """Objects and bytes in each of the 256 prefixes that listings run over in parallel."""
    return objects.groupBy(F.col("counter").bitwiseAND(255).cast("long").alias("prefix")).agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def directories(frames: DataFrame) -> DataFrame:
    """The directory of each segment: its frames in order."""
    entry = F.struct("frame_index", "byte_offset", "byte_len", "inode", "extent")
    return frames.groupBy("epoch", "counter").agg(F.sort_array(F.collect_list(entry)).alias("directory"))


def read_directories(segments: DataFrame) -> DataFrame:
    return segments.select("epoch", "counter", F.explode("directory").alias("e")).select("epoch", "counter", "e.byte_offset", "e.byte_len", "e.inode", "e.extent")


def read_runs(frames: DataFrame, first: int, last: int) -> DataFrame:
    """One ranged read of consecutive frames of each segment."""
    run = frames.where(F.col("frame_index").between(first, last))
    return run.groupBy("epoch", "counter").agg(F.count("*").alias("frames"), F.min("byte_offset").alias("start"), F.max(F.col("byte_offset") + F.col("byte_len")).alias("stop"))


def checkpoints(table: DataFrame) -> DataFrame:
    """Named checkpoints."""
    return table.where(F.length("name") > 0).select("id", "name", "created_at")


def snapshot(spark: SparkSession, path: str, version: str) -> DataFrame:
    """A pinned version of a table, read only."""
    return spark.read.parquet(f"{path}/version={version}")
