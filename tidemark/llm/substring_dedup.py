"""Removal of word windows that repeat in an earlier document.

Every window of ``width`` consecutive words gets a Rabin-Karp hash modulo three primes: 93 bits,
so that no two different windows of 100 TB (1.7e13 of them) are likely to share one.
Consecutive windows with the same minimiser (smallest hash of the short word
runs inside the window) form a run; equal windows have equal minimisers, so runs
are dealt to partitions by minimiser and windows are counted there.  A window
is repeated if its hash also occurs with a smaller doc_id.  Repeated windows merge
into maximal intervals of words, which are cut out of the texts.

Skew: minimisers whose runs exceed an average partition (there can be no more of
them than partitions) are found by a partial-aggregated count.  Their windows are
reduced to distinct hashes with smallest and largest doc_id before each shuffle, and
the hashes that repeat are looked up where the documents are read: as a sorted
array while they are at most ``BROADCAST_ROWS``, by a join beyond that.

Results for odd input: a null or empty text has 0 words and keeps the empty
string; texts shorter than the window lose nothing; rows with a null doc_id take
no part and lose nothing; rows of equal doc_id do not remove each other's words;
an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.llm._spark import BROADCAST_ROWS, partitions, saved, table

WIDTH = 50
#: Words of the short runs whose smallest hash is a window's minimiser.
SEED_WORDS = 10
#: Runs of one minimiser that are always handled in one task.
HOT_RUNS = 1000

#: Hash of a window: two residues mixed, and the third one.
WINDOW = np.dtype([("h", "<u8"), ("x", "<u4")])
#: Buckets of minimisers for each partition, so that partitions are about even.
BUCKETS = 4
#: What goes before a run's windows: minimiser, document, CRC, first word, number of windows.
HEAD = np.dtype([("m", "<i8"), ("doc", "<i8"), ("crc", "<i4"), ("pos", "<i4"), ("size", "<u4")])


def _minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have, step = values, 1
    while step * 2 <= width:
        have = np.minimum(have[:-step], have[step:])
        step *= 2
    rest = width - step
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def _runs(chunk: _text.Chunk, width: int) -> tuple[np.ndarray, ...]:
    """Of a chunk: window hashes; for each run its bounds in them, minimiser, first word and document."""
    every = _text.rolling(chunk.hash, width)
    at, doc = chunk.inside(every, width)
    hashes = np.empty(len(at), dtype=WINDOW)
    hashes["h"], hashes["x"] = every[at], _text.residue(chunk.hash, width, 2)[at]
    seed = min(SEED_WORDS, width)
    if not len(hashes):
        return hashes, np.zeros(1, dtype=np.int64), every, at, doc
    m = _minimum(_text.rolling(chunk.hash, seed), width - seed + 1)[at]
    new = np.ones(len(m), dtype=bool)
    new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return hashes, np.append(first, len(m)), m[first], at[first], doc[first]


def _parts(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    ids = batch.column("doc_id")
    known = np.asarray(ids.is_valid())
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    texts = _text.utf8(batch.column("text"))
    texts = [t if k else b"" for t, k in zip(texts, known, strict=True)]
    crc = np.array([zlib.crc32(t) for t in texts], dtype=np.uint32).view(np.int32)
    for chunk in _text.chunks(texts):
        hashes, bounds, m, word, doc = _runs(chunk, width)
        if len(m):
            rows = np.asarray(chunk.rows)[doc]
            yield hashes, bounds, m.view(np.int64), numbers[rows], crc[rows], (word - chunk.first[doc]).astype(np.int32)


def _ordered(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows that puts equal ones together, and where each kind of them begins in it."""
    order = np.argsort(w["h"], kind="stable")
    near, differ = (np.diff(w[k][order]) != 0 for k in ("h", "x"))
    if (~near & differ).any():  # different windows share their first 64 bits
        order = np.lexsort((w["x"], w["h"]))
        near, differ = (np.diff(w[k][order]) != 0 for k in ("h", "x"))
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(w)), dtype=bool), near | differ)))


def _packed(runs: np.ndarray, w: np.ndarray, bounds: np.ndarray, n_parts: int) -> pa.RecordBatch:
    """One row for each bucket of minimisers: how many runs, their heads, and their windows, in 32-bit words."""
    bucket = np.ascontiguousarray(runs["m"]).view(np.uint64) % np.uint64(n_parts)
    order = np.argsort(bucket, kind="stable")
    runs, bucket, size = runs[order], bucket[order].astype(np.int32), np.diff(bounds)[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    n = np.diff(np.append(first, len(runs)))
    head, each = HEAD.itemsize // 4, WINDOW.itemsize // 4
    words = 1 + head * n + each * np.add.reduceat(size, first)
    start = np.cumsum(words) - words
    out = np.empty(int(words.sum()), dtype=np.uint32)
    out[start] = n
    at = np.repeat(start + 1, n) + head * (np.arange(len(runs)) - np.repeat(first, n))
    out[at[:, None] + np.arange(head)] = np.ascontiguousarray(runs).view(np.uint32).reshape(-1, head)
    begin = np.cumsum(size) - size
    to = np.repeat(np.repeat(start + 1 + head * n - each * begin[first], n), size) + each * np.arange(int(size.sum()))
    source = np.arange(int(size.sum())) + np.repeat(bounds[:-1][order] - begin, size)
    out[to[:, None] + np.arange(each)] = np.ascontiguousarray(w[source]).view(np.uint32).reshape(-1, each)
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), _text.binary(out, np.append(start, len(out)))], ["bucket", "runs"])


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Heads and windows of a packed row."""
    n = int.from_bytes(blob[:4], "little")
    return np.frombuffer(blob, dtype=HEAD, count=n, offset=4), np.frombuffer(blob, dtype=WINDOW, offset=4 + n * HEAD.itemsize)


def _repeats(w: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows also occur with a smaller document."""
    order, first = _ordered(w)
    d = doc[order]
    least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(w))))
    out = np.zeros(len(w), dtype=bool)
    out[order] = d > least
    return out


def _merged(flags: np.ndarray, run: np.ndarray, pos: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of flagged windows within a run: run, first word, end word."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (run[at[1:]] != run[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return run[at[first]], pos[at[first]], pos[at[last]] + width


def repeated_intervals(docs: DataFrame, width: int = WIDTH, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, crc, start, end): word intervals covered by repeated windows; crc is the text's CRC-32."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n_parts = partitions(docs, 2.0)

    def counted(batches):
        for batch in _text.sliced(batches):
            got = [m for _, _, m, *_ in _parts(batch, width)]
            if got:
                m, n = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(n)], ["m", "n"])

    total = Observation()
    counts = docs.mapInArrow(counted, "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))
    counts = saved(counts.observe(total, F.sum("n").alias("runs")).filter(F.col("n") > hot_runs))
    load = max(hot_runs, (total.get["runs"] or 0) // n_parts)
    hot = np.sort(np.array([r.m for r in counts.where(F.col("n") > load).select("m").collect()], dtype=np.int64))  # fewer than n_parts

    def is_hot(m: np.ndarray) -> np.ndarray:
        if not len(hot):
            return np.zeros(len(m), dtype=bool)
        return hot[np.minimum(np.searchsorted(hot, m), len(hot) - 1)] == m

    def runs(batches):
        for batch in _text.sliced(batches):
            heads, windows = [], []
            for hashes, bounds, m, doc, crc, pos in _parts(batch, width):
                size = np.diff(bounds)
                keep = ~is_hot(m)
                own = np.empty(int(keep.sum()), dtype=HEAD)
                for name, values in (("m", m), ("doc", doc), ("crc", crc), ("pos", pos), ("size", size)):
                    own[name] = values[keep]
                heads.append(own)
                windows.append(hashes[np.repeat(keep, size)])
            if sum(map(len, heads)):
                own = np.concatenate(heads)
                yield _packed(own, np.concatenate(windows), np.concatenate(([0], np.cumsum(own["size"].astype(np.int64)))), BUCKETS * n_parts)

    def resolved(batches):
        heads, windows = [], []
        for batch in _text.sliced(batches):
            for blob in batch.column("runs"):
                own, w = _unpacked(blob.as_py())
                heads.append(own)
                windows.append(w)
        if not heads:
            return
        own, hashes = np.concatenate(heads), np.concatenate(windows)
        del heads, windows
        m, doc, crc, pos, sizes = (np.ascontiguousarray(own[k]) for k in HEAD.names)
        sizes = sizes.astype(np.int64)
        # a minimiser that only one document has can hold no repeated window
        order = np.argsort(m, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], m[order][1:] != m[order][:-1])))
        span = np.diff(np.append(first, len(m)))
        d = doc[order]
        shared = np.zeros(len(m), dtype=bool)
        shared[order] = np.repeat(np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first), span)
        each = np.repeat(shared, sizes)
        hashes = hashes[each]
        if not len(hashes):
            return
        run = np.repeat(np.flatnonzero(shared), sizes[shared])
        begin = np.cumsum(sizes[shared]) - sizes[shared]
        word = np.arange(len(run)) - np.repeat(begin, sizes[shared]) + pos[run]
        which, start, end = _merged(_repeats(hashes, doc[run]), run, word, width)
        yield pa.RecordBatch.from_arrays([pa.array(doc[which]), pa.array(crc[which]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc_id", "crc", "start", "end"])

    found = docs.mapInArrow(runs, "bucket int, runs binary").repartition(n_parts, "bucket").mapInArrow(resolved, "doc_id long, crc int, start int, end int")
    return found.unionAll(_hot_intervals(docs, is_hot, width, n_parts)) if len(hot) else found


def _distinct(w: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows in order with the smallest and the largest document of each."""
    if not len(w):
        return w, least, most
    order, first = _ordered(w)
    return w[order][first], np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)


def _known(known: np.ndarray, least: np.ndarray, w: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows are in a table sorted by (h, x) with a smaller document."""
    out = np.zeros(len(w), dtype=bool)
    if not len(known):
        return out
    h = np.ascontiguousarray(known["h"])
    at = np.searchsorted(h, w["h"])
    _, alike = np.unique(h, return_counts=True)
    for step in range(int(alike.max())):
        k = np.minimum(at + step, len(known) - 1)
        out |= (known[k] == w) & (least[k] < doc)
    return out


def _hot_intervals(docs: DataFrame, is_hot, width: int, n_parts: int) -> DataFrame:
    """Intervals of the windows whose minimiser is hot."""

    def reduced(batches):
        for batch in _text.sliced(batches):
            h, d = [], []
            for hashes, bounds, m, doc, _, _ in _parts(batch, width):
                size = np.diff(bounds)
                take = np.repeat(is_hot(m), size)
                h.append(hashes[take])
                d.append(np.repeat(doc, size)[take])
            if not sum(map(len, h)):
                continue
            h, least, most = _distinct(np.concatenate(h), np.concatenate(d), np.concatenate(d))
            bucket = (h["h"] % np.uint64(n_parts)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0)))
            bounds = np.append(first, len(h))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][first]), *(_text.binary(x[order], bounds) for x in (h, least, most))], ["bucket", "h", "least", "most"])

    def merged(batches):
        have = [[], [], []]
        for batch in _text.sliced(batches):
            for out, name, kind in zip(have, ("h", "least", "most"), (WINDOW, np.int64, np.int64), strict=True):
                out.append(np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=kind))
        if have[0]:
            h, least, most = _distinct(*(np.concatenate(x) for x in have))
            again = least < most
            yield pa.RecordBatch.from_arrays([pa.array([int(again.sum())], pa.int64()), pa.array([h[again].tobytes()]), pa.array([least[again].tobytes()])], ["n", "h", "least"])

    packed = docs.mapInArrow(reduced, "bucket int, h binary, least binary, most binary").repartition(n_parts, "bucket")
    repeated = saved(packed.mapInArrow(merged, "n long, h binary, least binary"))
    columns = ["doc_id", "crc", "start", "end"]
    schema = "doc_id long, crc int, start int, end int"
    if (repeated.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_ROWS:
        rows = repeated.collect()
        known = np.frombuffer(b"".join(r.h for r in rows), dtype=WINDOW)
        order = np.lexsort((known["x"], known["h"]))
        known, least = known[order], np.frombuffer(b"".join(r.least for r in rows), dtype=np.int64)[order]

        def looked_up(batches):
            for batch in _text.sliced(batches):
                for hashes, bounds, m, doc, crc, pos in _parts(batch, width):
                    run = np.repeat(np.arange(len(m)), np.diff(bounds))
                    flags = is_hot(m)[run] & _known(known, least, hashes, doc[run])
                    word = np.arange(len(hashes)) - bounds[run] + pos[run]
                    which, start, end = _merged(flags, run, word, width)
                    yield pa.RecordBatch.from_arrays([pa.array(doc[which]), pa.array(crc[which]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], columns)

        return docs.mapInArrow(looked_up, schema)

    def windows(batches):
        for batch in _text.sliced(batches):
            for hashes, bounds, m, doc, crc, pos in _parts(batch, width):
                run = np.repeat(np.arange(len(m)), np.diff(bounds))
                take = np.flatnonzero(is_hot(m)[run])
                word = (np.arange(len(hashes)) - bounds[run] + pos[run]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(hashes["h"].astype(np.uint64).view(np.int64)[take]), pa.array(hashes["x"].astype(np.int64)[take]), pa.array(doc[run][take]), pa.array(crc[run][take]), pa.array(word[take])], ["h", "x", "doc_id", "crc", "pos"])

    def spread(batches):
        for batch in _text.sliced(batches):
            for h, least in zip(batch.column("h").to_pylist(), batch.column("least").to_pylist(), strict=True):
                w = np.frombuffer(h, dtype=WINDOW)
                yield pa.RecordBatch.from_arrays([pa.array(w["h"].astype(np.uint64).view(np.int64)), pa.array(w["x"].astype(np.int64)), pa.array(np.frombuffer(least, dtype=np.int64))], ["h", "x", "least"])

    each = docs.mapInArrow(windows, "h long, x long, doc_id long, crc int, pos int")
    again = each.join(repeated.mapInArrow(spread, "h long, x long, least long"), ["h", "x"]).filter(F.col("doc_id") > F.col("least"))
    return again.select("doc_id", "crc", F.col("pos").alias("start"), (F.col("pos") + width).cast("int").alias("end"))


def _cut(words: list[bytes], starts: list[int], ends: list[int]) -> tuple[list[bytes], int]:
    """Words outside the intervals, and how many were inside."""
    covered = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(covered, np.asarray(starts, dtype=np.int64), 1)
    np.add.at(covered, np.asarray(ends, dtype=np.int64), -1)
    inside = np.cumsum(covered[:-1]) > 0
    return [w for w, x in zip(words, inside.tolist(), strict=True) if not x], int(inside.sum())


def remove_repeats(docs: DataFrame, width: int = WIDTH, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the kept words joined by one space)."""
    return _kept(docs, width, hot_runs, digest=False)


def _kept(docs: DataFrame, width: int, hot_runs: int, digest: bool) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = repeated_intervals(docs, width, hot_runs)
    by_doc = found.groupBy("doc_id", "crc").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))

    def packed(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in _text.sliced(batches):
            texts = _text.utf8(batch.column("text"))
            crc = np.array([zlib.crc32(t) for t in texts], dtype=np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(crc), pa.array([squeeze.compress(t) for t in texts], pa.binary())], ["doc_id", "crc", "packed"])

    def cut(batches):
        expand = zstandard.ZstdDecompressor()
        for batch in _text.sliced(batches):
            out = []
            for blob, starts, ends in zip(batch.column("packed").to_pylist(), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                words = expand.decompress(blob).split()
                kept, gone = _cut(words, starts, ends) if starts else (words, 0)
                text = b" ".join(kept)
                out.append((len(words), gone, hashlib.sha256(text).hexdigest() if digest else text.decode()))
            n, gone, text = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string())], ["doc_id", "n_words", "n_removed", last])

    last = "kept_sha256" if digest else "kept"
    joined = docs.mapInArrow(packed, "doc_id long, crc int, packed binary").join(by_doc, ["doc_id", "crc"], "left")
    return joined.select("doc_id", "packed", "starts", "ends").mapInArrow(cut, f"doc_id long, n_words long, n_removed long, {last} string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(table(spark, sf_dir, "documents"), WIDTH, HOT_RUNS, digest=True)


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + {WIDTH - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM d WHERE len(w) >= {WIDTH})),
hit AS (SELECT win.doc_id, i FROM win JOIN (SELECT g, min(doc_id) AS least FROM win GROUP BY g) f ON f.g = win.g WHERE win.doc_id > least),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + {WIDTH})) AS p FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id
"""
