"""Session windows against a loop over sorted events, at gaps around the limit and over several micro-batches."""

import random
from itertools import pairwise

from pyspark.sql import functions as F

from tidemark.streaming import streams

GAP = 1800


def folded(events):
    """(user, start, stop, events) of each run of events less than a gap apart."""
    out = []
    for user, ts in sorted(events):
        if out and out[-1][0] == user and ts - out[-1][2] < GAP:
            out[-1][2:] = [ts, out[-1][3] + 1]
        else:
            out.append([user, ts, ts, 1])
    return sorted((u, a, b + GAP, n) for u, a, b, n in out)


def streamed(spark, folder, batches):
    """Sessions of a stream that reads a file of (user, seconds) in each micro-batch."""
    for k, events in enumerate(batches):
        spark.createDataFrame(events, "user_id long, ts long").coalesce(1).write.parquet(f"{folder}/in/part{k}")
    stream = spark.readStream.schema("user_id long, ts long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    rows = streams.sessions(stream.select("user_id", F.timestamp_seconds("ts").alias("time")), "30 minutes", ["user_id"])
    return sorted(tuple(r) for r in streams.complete(rows).select("user_id", "start", "stop", "events").collect())


def test_events_a_whole_gap_apart_are_two_sessions(spark, tmp_path):
    events = [(1, 0), (1, 1799), (2, 0), (2, 1800), (3, 0), (3, 1801), (4, 5), (4, 5), (4, 1805), (4, 3605)]
    want = [(1, 0, 3599, 2), (2, 0, 1800, 1), (2, 1800, 3600, 1), (3, 0, 1800, 1), (3, 1801, 3601, 1), (4, 5, 1805, 2), (4, 1805, 3605, 1), (4, 3605, 5405, 1)]
    assert folded(events) == want
    assert streamed(spark, tmp_path, [events]) == want


def test_sessions_over_micro_batches(spark, tmp_path):
    draw = random.Random(5)
    events = [(user, ts) for user in range(12) for ts in (draw.randrange(0, 400) * 300 + draw.choice([0, 0, 0, 1]) for _ in range(40))]
    draw.shuffle(events)  # each batch has events from all over the time, so most come late
    assert sum(b == (a[0], a[1] + GAP) for a, b in pairwise(sorted(events))) > 10
    assert streamed(spark, tmp_path, [events[k::4] for k in range(4)]) == folded(events)
