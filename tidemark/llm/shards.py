"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``VNODES`` places on a ring of 64-bit hashes; a document belongs to the
first place at or after its own hash.  A shard takes no more than its capacity, and
documents that find it full go on clockwise to the next place.  Capacities are the
floor or the ceiling of the mean, so the law is ``rows``: counts differ by one at most.

Only counts per arc of the ring (a number fixed by shards and virtual nodes) reach the
driver; there the overflow is worked out for stretches of each arc's order, and a
document finds its stretch by its rank in the arc.  Ranks are counted in bins of the
arcs whose number follows the input, and a bin that holds far more than others (rows that repeat
have one place on the ring) is split by row, so no task sorts an arc or a hot place alone.

Results for odd input: a null text has size 8 and CRC 0; rows with a null doc_id have
the place of their text; repeated rows share a place on the ring and take slots of their own; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._spark import saved, small, table

SHARDS = 24
VNODES = 64
#: Documents that a bin of an arc is sized for.
BIN_ROWS = 20_000
#: A bin with so many times as many is split by row.
HOT_BINS = 4


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places on the ring in order, and the shard of each."""
    at = np.array([xxhash.xxh3_64_intdigest(f"{s}/{v}") - (1 << 63) for s in range(shards) for v in range(vnodes)], dtype=np.int64)
    order = np.argsort(at, kind="stable")
    return at[order], (order // vnodes).astype(np.int32)


def stretches(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, first slot) for all documents, given the documents of each arc."""
    total = sum(counts)
    even, over = divmod(total, shards)
    load = [0] * shards
    out = []
    waiting = [[(arc, 0, n)] if n else [] for arc, n in enumerate(counts)]
    while any(waiting):
        moved = [[] for _ in counts]
        for place, queue in enumerate(waiting):
            shard = owners[place]
            for arc, a, b in queue:
                room = even + (over > 0) - load[shard] if load[shard] <= even else 0
                take = min(b - a, max(0, room))
                if take:
                    out.append((arc, a, a + take, shard, load[shard]))
                    load[shard] += take
                    over -= load[shard] == even + 1
                if a + take < b:
                    moved[(place + 1) % len(counts)].append((arc, a + take, b))
        waiting = moved
    return out


def _placed(rows: DataFrame, at: np.ndarray, bins: int) -> DataFrame:
    """Rows with the arc of their place and its bin; places past the last one are in the first arc, after its own bins."""
    n, step = len(at), max(1, int(len(at) ** 0.5))
    listed = lambda xs: f"array({', '.join(f'{int(x)}L' if x > -edge else '-9223372036854775807L - 1L' for x in xs)})"
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col("pos")))
    edge = 1 << 63
    # two short searches: among every step-th place, then among those up to the next of them
    rows = rows.withColumn("coarse", below(F.expr(listed(at[step - 1 :: step])) if n >= step else F.array().cast("array<bigint>")))
    blocks = F.expr(f"array({', '.join(listed(at[k : k + step]) if k < n else 'CAST(array() AS ARRAY<BIGINT>)' for k in range(0, n + 1, step))})")
    rows = rows.withColumn("k", F.col("coarse") * step + below(F.get(blocks, F.col("coarse"))))
    low = F.expr(listed([-edge, *map(int, at)]))
    span = F.expr(f"array({', '.join(f'{float(max(b - a, 1))!r}D' for a, b in zip([-edge, *map(int, at)], [*map(int, at), edge], strict=True))})")
    share = (F.col("pos").cast("double") - F.get(low, F.col("k")).cast("double")) / F.get(span, F.col("k"))
    rows = rows.withColumn("part", F.greatest(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0)).cast("int"))
    past = F.col("k") == n
    return rows.withColumn("arc", F.when(past, 0).otherwise(F.col("k")).cast("int")).withColumn("part", F.when(past, F.col("part") + bins).otherwise(F.col("part")).cast("int")).drop("coarse", "k")


def assign(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null for this law)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("pos", F.xxhash64("doc_id", "text_crc32"))
    rows = saved(rows.withColumn("rid", F.monotonically_increasing_id()))  # fixed once written
    at, owners = ring(shards, vnodes)
    bins = max(1, -(-rows.count() // (bin_rows * len(at))))

    rows = _placed(rows, at, bins)
    loads = saved(rows.groupBy("arc", "part").agg(F.count("*").alias("n")))
    hot = saved(loads.where(F.col("n") > HOT_BINS * bin_rows).select("arc", "part", F.ceil(F.col("n") / bin_rows).alias("pieces")))
    if hot.limit(1).count():
        rows = rows.join(small(hot), ["arc", "part"], "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("rid"), "pieces"), F.lit(0).cast("long"))).drop("pieces")
        counts = saved(rows.groupBy("arc", "part", "piece").agg(F.count("*").alias("n")))
    else:
        rows, counts = (x.withColumn("piece", F.lit(0).cast("long")) for x in (rows, loads))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("arc").orderBy("part", "piece")) - F.col("n")).drop("n")
    per_arc = [0] * len(at)
    for r in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # a row for each arc
        per_arc[r.arc] = r.n
    found = stretches(per_arc, owners.tolist(), shards)
    flow = spark.createDataFrame(pa.table({k: pa.array([x[i] for x in found], t) for i, (k, t) in enumerate((("arc", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("shard", pa.int32()), ("base", pa.int64())))}))
    order = Window.partitionBy("arc", "part", "piece").orderBy("pos", "doc_id", "text_crc32", "size", "rid")
    ranked = rows.withColumn("rn", F.row_number().over(order) - 1).join(before, ["arc", "part", "piece"]).withColumn("rank", F.col("rn") + F.col("before"))
    inside = (ranked.arc == flow.arc) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b"))
    out = ranked.join(F.broadcast(flow), inside)  # a stretch for each arc, and one more for each time that a shard fills
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("a")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
