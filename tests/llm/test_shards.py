import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, empty, odd_rows, prose

from tidemark.llm import shards


def sequential(keys, n, vnodes):
    """Key by key: each wave goes clockwise past full shards."""
    at, owner = shards.ring(n, vnodes)
    even, over = divmod(len(keys), n)
    waves = [[] for _ in at]
    for pos, key in keys:
        k = int(np.searchsorted(at, pos))
        waves[k % len(at)].append((k == len(at), pos, key))
    waves = [sorted(w) for w in waves]
    load, out = [0] * n, {}
    while any(waves):
        after = [[] for _ in waves]
        for k, wave in enumerate(waves):
            for x in wave:
                s = owner[k]
                if load[s] < even or load[s] == even and over:
                    over -= load[s] == even
                    load[s] += 1
                    out[x[2]] = int(s)
                else:
                    after[(k + 1) % len(waves)].append(x)
        waves = after
    return out


@pytest.mark.parametrize(("n", "vnodes", "bin_rows"), [(24, 64, 20_000), (5, 3, 1), (3, 40, 2)])
def test_against_one_by_one(spark, monkeypatch, n, vnodes, bin_rows):
    monkeypatch.setattr(shards, "HOT_BINS", 1000)
    rows = [(k, prose(k, 3), "en", "s") for k in range(500)]
    got = shards.assign(documents(spark, rows).repartition(3), n, vnodes, bin_rows).collect()
    pos = documents(spark, rows).selectExpr("xxhash64(doc_id, crc32(CAST(text AS BINARY))) AS pos", "doc_id").collect()
    assert {r.doc_id: r.shard for r in got} == sequential([(p.pos, p.doc_id) for p in pos], n, vnodes)


def test_law_and_slots(spark):
    got = shards.assign(documents(spark)).collect()
    assert len(got) == len(odd_rows())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    loads = Counter(r.shard for r in got)
    assert max(loads.values()) - (min(loads.values()) if len(loads) == 24 else 0) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.assign(empty(spark)).count() == 0


def test_few_documents_move(spark):
    rows = [(k, prose(k, 2), "en", "s") for k in range(2000)]
    a, b = ({r.doc_id: r.shard for r in shards.assign(documents(spark, rows), n).collect()} for n in (10, 11))
    assert sum(a[k] != b[k] for k in a) < 2000 * 0.45


def test_rows_that_repeat_are_spread(spark):
    rows = [(1, "same", "en", "s")] * 300 + [(None, None, "en", "s")] * 200 + [(k, prose(k, 2), "en", "s") for k in range(2, 100)]
    got = shards.assign(documents(spark, rows).repartition(3), bin_rows=5).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    loads = Counter(r.shard for r in got)
    assert len(loads) == 24 and max(loads.values()) - min(loads.values()) <= 1
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in sorted(loads) for k in range(loads[s])]
