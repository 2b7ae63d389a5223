"""Joins of segments, frames, objects and the forward map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
SEGMENT = ["epoch", "counter"]
#: Extents that a range is unfolded by at once.
STEP = 1 << 14


def verdicts(frames: DataFrame, views: list[DataFrame], objects: DataFrame) -> DataFrame:
    """Per segment: keep if any frame is referenced in any view, absent if no object exists, else reclaim."""
    refs = views[0].select("inode", "extent", *SEGMENT)
    for v in views[1:]:
        refs = refs.unionAll(v.select("inode", "extent", *SEGMENT))
    named = frames.select(*SEGMENT, "inode", "extent").distinct()
    alive = named.join(refs, ["inode", "extent", *SEGMENT], "left_semi").select(*SEGMENT).distinct().withColumn("alive", F.lit(True))
    there = objects.select(*SEGMENT).distinct().withColumn("there", F.lit(True))
    rows = frames.select(*SEGMENT).distinct().join(alive, SEGMENT, "left").join(there, SEGMENT, "left")
    return rows.select(*SEGMENT, F.when(c("alive"), "keep").when(c("there").isNull(), "absent").otherwise("reclaim").alias("verdict"))


def gather(frames: DataFrame, extents: DataFrame, sources: DataFrame) -> DataFrame:
    """Live bytes of the source segments, each (inode, extent) once, the first source winning."""
    picked = sources.select(*SEGMENT, "rank").join(frames.select(*SEGMENT, "inode", "extent").distinct(), SEGMENT)
    live = picked.join(extents, ["inode", "extent", *SEGMENT])
    return live.groupBy("inode", "extent").agg(F.min_by(F.struct(*SEGMENT, "frame_index", "byte_len"), "rank").alias("x")).select("inode", "extent", "x.*")


def orphan_objects(objects: DataFrame, counters: DataFrame, extents: DataFrame, modified_before: int) -> DataFrame:
    """Old objects that no counter knows and no extent refers to."""
    old = objects.where(c("mtime") < modified_before).join(counters.select(*SEGMENT), SEGMENT, "left_anti")
    return old.join(extents.select(*SEGMENT).distinct(), SEGMENT, "left_anti")


def dead_without_object(counters: DataFrame, objects: DataFrame) -> DataFrame:
    return counters.where("live = 0").join(objects.select(*SEGMENT), SEGMENT, "left_anti")


def read_ranges(reads: DataFrame, extents: DataFrame, extent_bytes: int = 32768, place: tuple[str, ...] = ()) -> DataFrame:
    """Every extent that a byte range touches, with its segment (and columns ``place``) or as a hole, and the bytes wanted of it."""
    first = F.floor(c("offset") / extent_bytes)
    last = F.floor((c("offset") + c("length") - 1) / extent_bytes)
    rows = reads.select("event_id", "inode", "offset", "length", first.alias("first_"), last.alias("last_"))
    # in two steps, so that no array grows with the range
    rows = rows.withColumn("from_", F.explode(F.sequence("first_", "last_", F.lit(STEP)))).withColumn("extent", F.explode(F.sequence("from_", F.least(c("from_") + STEP - 1, c("last_")))))
    begin, end = c("extent") * extent_bytes, (c("extent") + 1) * extent_bytes
    rows = rows.withColumn("wanted", F.least(end, c("offset") + c("length")) - F.greatest(begin, c("offset")))
    return rows.join(extents.select("inode", "extent", *SEGMENT, *place), ["inode", "extent"], "left").select("event_id", "inode", "extent", "wanted", *SEGMENT, *place, c("epoch").isNull().alias("hole"))


def live_pairs(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Pairs of segments both of which hold live bytes."""
    alive = segments.where("live > 0")
    for s in "ab":
        pairs = pairs.join(alive.select(c("epoch").alias(f"epoch_{s}"), c("counter").alias(f"counter_{s}")), [f"epoch_{s}", f"counter_{s}"], "left_semi")
    return pairs


def repoint(extents: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forward map after compaction, and the (segment, d_live) deltas.

    A move (inode, extent, old location, new_epoch, new_counter) wins only if the map still
    has the old location.
    """
    rows = extents.join(moves.select("inode", "extent", *SEGMENT, "frame_index", "new_epoch", "new_counter"), ["inode", "extent", *SEGMENT, "frame_index"], "left")
    after = rows.select("inode", "extent", F.coalesce("new_epoch", "epoch").alias("epoch"), F.coalesce("new_counter", "counter").alias("counter"), "byte_len")
    won = rows.where("new_epoch is not null")
    gain = won.groupBy(c("new_epoch").alias("epoch"), c("new_counter").alias("counter")).agg(F.sum("byte_len").alias("d_live"))
    loss = won.groupBy(*SEGMENT).agg((-F.sum("byte_len")).alias("d_live"))
    return after, gain.unionAll(loss).groupBy(*SEGMENT).agg(F.sum("d_live").alias("d_live"))


def scan_consistency(entries: DataFrame, scan: DataFrame) -> DataFrame:
    """Disagreements of the two directory tables, both ways."""
    e = entries.select("dir_id", "cookie", c("name").alias("entry_name"))
    s = scan.select("dir_id", "cookie", c("name").alias("scan_name"))
    kind = F.when(c("scan_name").isNull(), "entry_without_scan").when(c("entry_name").isNull(), "scan_without_entry").when(c("entry_name") != c("scan_name"), "name_mismatch")
    return e.join(s, ["dir_id", "cookie"], "full").withColumn("violation", kind).where("violation is not null")
