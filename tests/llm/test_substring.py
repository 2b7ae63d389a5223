import hashlib

import numpy as np
import pytest
from helpers import documents, empty, words

from tidemark.llm import substring_dedup


def brute(rows, width):
    first = {}
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "broadcast", "width"), [(1000, 10**6, 50), (0, 10**6, 50), (0, 0, 50), (1000, 10**6, 5)])
def test_against_all_windows(spark, monkeypatch, hot, broadcast, width):
    from helpers import odd_rows

    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", broadcast)
    got = substring_dedup._kept(documents(spark).repartition(3), width, hot, digest=True)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(odd_rows(), width)


def test_texts_and_empty_table(spark):
    kept = {r.doc_id: r.kept for r in substring_dedup.remove_repeats(documents(spark, [(1, "a b  c", None, None), (2, None, None, None)])).collect()}
    assert kept == {1: "a b c", 2: ""}
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_windows_that_share_64_bits_stay_apart():
    w = np.array([(5, 1), (5, 2), (5, 1), (7, 1), (5, 2)], dtype=substring_dedup.WINDOW)
    assert substring_dedup._repeats(w, np.array([1, 2, 3, 4, 4])).tolist() == [False, False, True, False, True]
    kinds, least, most = substring_dedup._distinct(w, np.arange(5), np.arange(5))
    assert kinds.tolist() == [(5, 1), (5, 2), (7, 1)] and least.tolist() == [0, 1, 3] and most.tolist() == [2, 4, 3]
    known = np.array([(5, 1), (5, 2)], dtype=substring_dedup.WINDOW)
    assert substring_dedup._known(known, np.array([3, 1]), w, np.array([2, 2, 4, 9, 1])).tolist() == [False, True, True, False, False]


def test_packed_runs_come_back():
    draw = np.random.default_rng(4)
    for parts in (1, 3, 50):
        size = draw.integers(1, 6, 40)
        runs = np.zeros(40, dtype=substring_dedup.HEAD)
        runs["m"], runs["doc"], runs["size"] = draw.integers(-9, 9, 40), np.arange(40), size
        w = np.zeros(int(size.sum()), dtype=substring_dedup.WINDOW)
        w["h"], w["x"] = np.arange(len(w)), 7
        bounds = np.concatenate(([0], np.cumsum(size)))
        batch = substring_dedup._packed(runs, w, bounds, parts)
        got = {}
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            heads, windows = substring_dedup._unpacked(blob)
            at = 0
            for r in heads:
                assert int(np.int64(r["m"]).astype(np.uint64)) % parts == bucket
                got[int(r["doc"])] = windows["h"][at : at + int(r["size"])].tolist()
                at += int(r["size"])
        assert got == {k: list(range(bounds[k], bounds[k + 1])) for k in range(40)}
