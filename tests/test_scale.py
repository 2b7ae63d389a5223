"""Deep trees, wide ranges, long series: what once stopped at a limit of the engine."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, changelog, heat, intervals, liveness, mutate, namespace, policy, series

DEPTH, FILES = 200, 10_500


@pytest.fixture(scope="module")
def tree(spark):
    """A chain of directories with files at its end, a cycle of two, and a directory whose parent is gone."""
    dirs = spark.range(DEPTH + 1).selectExpr("id AS inode_id", "'directory' AS kind", "CASE WHEN id = 0 THEN 0 ELSE id - 1 END AS parent", "CASE WHEN id > 0 THEN concat('d', id) END AS name")
    files = spark.range(FILES).selectExpr("id + 100000 AS inode_id", "'file' AS kind", f"CAST({DEPTH} AS BIGINT) AS parent", "concat('f', id) AS name")
    odd = spark.createDataFrame([(9001, "directory", 9002, "x"), (9002, "directory", 9001, "y"), (9003, "file", 9001, "z"), (9004, "directory", 77777, "lost"), (9005, "file", None, None)], "inode_id long, kind string, parent long, name string")
    return dirs.unionByName(files).unionByName(odd)


def test_deep_chains(spark, tree):
    rows = namespace.chains(tree).where("inode_id >= 100000 or inode_id > 9000 or inode_id < 3").groupBy("inode_id").agg(F.count("*").alias("n"), F.max("depth").alias("deep"), F.max_by("at", "depth").alias("top"))
    got = {r.inode_id: (r.n, r.deep, r.top) for r in rows.collect()}
    assert sum(n for n, *_ in got.values()) > 2_000_000
    assert set(list(got[k] for k in range(100_000, 100_000 + FILES))) == {(DEPTH + 2, DEPTH + 1, 0)}
    assert got[0] == (1, 0, 0) and got[2] == (3, 2, 0) and got[9004] == (2, 1, 77777) and got[9005] == (1, 0, 9005)
    assert got[9001] == (1, 0, 9001) and got[9003] == (1, 0, 9003)


def test_deep_paths(tree):
    got = {r.inode_id: r.path for r in namespace.paths(tree.where("inode_id < 100010")).collect()}
    deep = "".join(f"/d{k}" for k in range(1, DEPTH + 1))
    assert got[0] == "/" and got[DEPTH] == deep and got[100_003] == f"{deep}/f3" and got[9005] == "<inode:9005>" and got[9004] == "/lost"


def test_deep_ancestors(spark, tree):
    pairs = spark.createDataFrame([(0, 100_001), (150, 100_001), (100_001, 100_001), (100_001, 150), (150, 150), (151, 150), (0, 0), (5, 0), (9002, 9001), (4, 424242)], "ancestor long, inode_id long")
    got = {(r.ancestor, r.inode_id): r.yes for r in namespace.is_ancestor(tree, pairs).collect()}
    assert {k for k, yes in got.items() if yes} == {(0, 100_001), (150, 100_001), (100_001, 100_001), (150, 150), (0, 0), (9002, 9001)}


def test_deep_walks_and_detached_trees(spark, tree):
    entries = tree.where("inode_id <> 0 and parent is not null").select(F.col("parent").alias("dir_id"), "name", "inode_id", F.lit(1).alias("cookie"))
    deep = namespace.walk(entries).groupBy("depth").count().orderBy("depth").collect()
    assert [(r.depth, r["count"]) for r in deep] == [(k, 1) for k in range(1, DEPTH + 1)] + [(DEPTH + 1, FILES)]
    hit = namespace.search(entries, F.lit("^f77$"), max_depth=500).collect()
    assert [(r.inode_id, r.depth) for r in hit] == [(100_077, DEPTH + 1)]
    inodes = tree.select("inode_id", "kind", F.lit(1).alias("nlink"), F.lit(5).alias("size"))
    left = {r.inode_id for r in audit.unreferenced(inodes, entries, spark.createDataFrame([(9005,)], "inode_id long")).collect()}
    assert left == {9001, 9002, 9003, 9004}
    assert audit.dangling_entries(entries, inodes.where("inode_id not in (9003, 100005)")).select("inode_id").collect() == [(100_005,)]


def test_lock_conflicts_of_any_width(spark):
    draw = random.Random(2)
    length = lambda: draw.choice([0, 1, 5, 900, 2000, 70_000, 1 << 25, 1 << 50])
    locks = [(draw.randrange(2), draw.randrange(3), draw.choice(["read", "write"]), draw.choice([0, draw.randrange(5000), draw.randrange(1 << 20), draw.randrange(1 << 45)]), length()) for _ in range(120)]
    held, wanted = (spark.createDataFrame(x, "inode long, owner long, kind string, start long, length long") for x in (locks[:60], locks[60:]))
    end = lambda x: x[3] + x[4] if x[4] else intervals.OPEN
    want = sorted((h[0], *h[1:], *w[1:]) for h in locks[:60] for w in locks[60:] if h[0] == w[0] and h[1] != w[1] and "write" in (h[2], w[2]) and h[3] < end(w) and w[3] < end(h))
    assert len(want) > 100 and sorted(tuple(r) for r in intervals.conflicts(held, wanted).collect()) == want


def test_wide_trims_and_reads(spark):
    draw = random.Random(3)
    cells = [(i, e, 7) for i in range(3) for e in draw.sample(range(400), 60)] + [(1, 1 << 30, 7)]
    ranges = [(draw.randrange(3), draw.randrange(300) * 1000, draw.choice([0, 40_000, 900_000, 5_000_000])) for _ in range(12)] + [(1, 1 << 20, 1 << 50)]
    got = mutate.trim(spark.createDataFrame(cells, "inode long, extent long, byte_len long"), spark.createDataFrame(ranges, "inode long, offset long, length long"))
    gone = {(i, e) for i, e, _ in cells if any(j == i and e * 32768 >= o and (e + 1) * 32768 <= o + n for j, o, n in ranges)}
    want = {i: sum(k[0] == i for k in gone) for i in {k[0] for k in gone}}
    assert {r.inode: r.dropped for r in got.collect()} == want
    reads = spark.createDataFrame([(1, 0, 0, 32768 * 50_000), (2, 0, 5, 10)], "event_id long, inode long, offset long, length long")
    touched = liveness.read_ranges(reads, spark.createDataFrame([(0, 3, 1, 1)], "inode long, extent long, epoch long, counter long"))
    assert touched.groupBy("event_id").agg(F.count("*"), F.count_if("hole"), F.max("extent")).orderBy("event_id").collect() == [(1, 50_000, 49_999, 49_999), (2, 1, 1, 0)]


def test_series_in_parts(spark):
    draw = random.Random(4)
    rows, value = [], 0
    for ts in range(0, 4000, 3):
        value += draw.choice([0, 0, 0, 2])
        rows.append((ts, value, draw.randrange(4)))
    df = spark.createDataFrame(rows, "ts long, n long, gauge long").repartition(5)
    before = [None, *rows[:-1]]
    got = {r.ts: r for r in series.rates(df, "ts", ["n"]).collect()}
    assert len(got) == len(rows) and all(got[x[0]].dt == (x[0] - p[0] if p else None) and got[x[0]].n_rate == ((x[1] - p[1]) / 3 if p else None) for x, p in zip(rows, before, strict=True))
    assert {r.ts for r in series.idle(df, "ts", ["n"]).where("idle").collect()} == {x[0] for x, p in zip(rows, before, strict=True) if p and x[1] == p[1]}
    assert {r.ts for r in series.crossings(df, "ts", F.col("gauge") >= 2).collect()} == {x[0] for x, p in zip(rows, before, strict=True) if x[2] >= 2 and not (p and p[2] >= 2)}
    since, want = 0, {}
    for x, p in zip(rows, before, strict=True):
        since = x[0] if p is None or p[1] != x[1] else since
        want[x[0]] = x[0] - since
    assert {r.ts: r.unchanged_for for r in series.quiescent(df, "ts", "n", 9).collect()} == want
    log = spark.createDataFrame([(draw.randrange(5) if k % 50 else k // 300, k, 0) for k in range(2000)], "epoch long, seqno long, op_index long").repartition(3)
    top, keep = -1, []
    for r in sorted(log.collect(), key=lambda r: r.seqno):
        top = max(top, r.epoch)
        keep += [r.seqno] if r.epoch >= top else []
    assert sorted(r.seqno for r in changelog.accepted_epochs(log).collect()) == keep


def test_heat_tells_epochs_apart(spark):
    events = spark.createDataFrame([(1, 7, 2, 7, 0, 5), (2, 7, 1, 7, 1, 9), (1, 7, 1, 7, 0, 5)], "epoch_a long, counter_a long, epoch_b long, counter_b long, round long, ts long")
    got = sorted(tuple(r) for r in heat.pair_heat(events).collect())
    assert got == [(1, 7, 1, 7, 0, 1, 5), (1, 7, 2, 7, 0, 1, 5), (1, 7, 2, 7, 1, 2, 9)]


def test_rounds_take_pairs_that_reads_cross(spark):
    segments = [(1, k, live, 900, "keep", False, True) for k, live in ((1, 60), (2, 30), (3, 30), (4, 5))] + [(1, 9, 10, 100, "candidate", False, True)]
    rows = spark.createDataFrame(segments, "epoch long, counter long, live long, permille long, class string, nominated boolean, cold boolean")
    pairs = spark.createDataFrame([(1, 1, 1, 2, 3), (1, 1, 1, 3, 3), (1, 2, 1, 3, 2), (1, 1, 1, 77, 9)], "epoch_a long, counter_a long, epoch_b long, counter_b long, heat long")
    got = [(r.counter, r.reason) for r in policy.select_round(rows, pairs, 140).orderBy("place").collect()]
    # the prefix (1) is too short, the cheapest pair that reads cross is 2 and 3
    assert got == [(2, "chain"), (3, "chain"), (9, "rank")]
    got = [(r.counter, r.reason) for r in policy.select_round(rows, pairs.where("counter_a = 1"), 140).orderBy("place").collect()]
    assert got == [(9, "rank")]


def test_merged_batches_and_exempt_ids(spark, tmp_path):
    from tidemark.streaming import streams

    draw = random.Random(7)
    rows = [(draw.randrange(40), k, k * 10, draw.choice(["put", "put", "delete"])) for k in range(300)]
    schema = "key long, seqno long, value long, op string"
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], schema).coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    last = {r[0]: r for r in rows}
    got = streams.merged(stream, ["key"], ["seqno"], buckets=5).collect()
    assert {r.key: r.value for r in got} == {k: r[2] for k, r in last.items() if r[3] == "put"}
    ops = spark.createDataFrame([(k % 3, k) for k in range(12)], "op_id long, event_id long")
    ops.write.parquet(str(tmp_path / "ops"))
    source = spark.readStream.schema(ops.schema).parquet(str(tmp_path / "ops")).withColumn("time", F.timestamp_seconds("event_id"))
    got = streams.appended(streams.once(source, "op_id", "1 hour").select("op_id", "event_id")).collect()
    assert sorted(r.event_id for r in got if r.op_id == 0) == [0, 3, 6, 9] and sorted(r.op_id for r in got if r.op_id) == [1, 2]
