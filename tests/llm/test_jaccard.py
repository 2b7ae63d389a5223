import random

import pytest
from helpers import documents, empty, odd_rows, prose

from tidemark.llm import jaccard_join


def shingles(text):
    w = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    up = list(range(len(sets)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for x, (i, s) in enumerate(sets):
        for y in range(x):
            j, o = sets[y]
            both = len(s & o)
            if i is not None and j is not None and s and o and 100 * both >= 75 * (len(s) + len(o) - both):
                up[top(x)] = top(y)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(s), least[top(k)] if i is not None else None) for k, (i, s) in enumerate(sets)), key=str)


def family(seed, copies, edits, n=150):
    draw = random.Random(seed)
    base = prose(seed, n).split()
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(draw.randint(0, edits)):
            w[draw.randrange(n)] = prose(draw.random(), 1)
        out.append(" ".join(w))
    return out


def corpus():
    passage = prose(77, 60)
    texts = family(1, 25, 6) + family(2, 40, 3) + [f"{passage} {prose(100 + k, 30 + k)}" for k in range(40)] + [prose(300 + k, 1 + k % 12) for k in range(30)] + family(4, 12, 2, n=14)
    return odd_rows() + [(100 + k, t, "en", "s") for k, t in enumerate(texts)]


@pytest.mark.parametrize(("max_group", "members"), [(1, 6), (8, 2048)])
def test_against_all_pairs(spark, monkeypatch, max_group, members):
    monkeypatch.setattr(jaccard_join, "MEMBERS", members)
    rows = corpus()
    got = jaccard_join.near_duplicates(documents(spark, rows).repartition(3), max_group=max_group)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty_table_and_bounds(spark):
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        jaccard_join.near_duplicates(empty(spark), percent=70)


def test_odd_sketches_are_lower_bounds():
    draw = random.Random(3)
    import numpy as np

    for _ in range(200):
        x = np.array(sorted({draw.getrandbits(64) for _ in range(draw.randint(1, 90))}), dtype=np.uint64)
        y = np.union1d(x[: draw.randint(0, len(x))], np.array([draw.getrandbits(64) for _ in range(draw.randint(1, 60))], dtype=np.uint64))
        sketches = [int.from_bytes(jaccard_join._parity([s], len(s).bit_length() - 1).tobytes(), "little") for s in (x, y)]
        sizes = [jaccard_join._bits(len(s).bit_length() - 1) for s in (x, y)]
        u, v = (jaccard_join._folded(s, n, min(sizes)) for s, n in zip(sketches, sizes, strict=True))
        assert (u ^ v).bit_count() <= len(np.setxor1d(x, y))


def brute_links(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    near = lambda s, o: 100 * len(s & o) >= 75 * len(s | o)
    return sorted(((i, None if i is None else sum(bool(j is not None and s and o and k != m and near(s, o)) for m, (j, o) in enumerate(sets))) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("block", [5, 256])
def test_link_counts_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    rows = corpus() + [(900 + k, t, "en", "s") for k, t in enumerate(family(9, 30, 12))]
    want = brute_links(rows)
    assert max(n or 0 for _, n in want) > 30
    got = jaccard_join.near_duplicates(documents(spark, rows).repartition(3), links=True)
    assert sorted(((r.doc_id, r.n_links) for r in got.collect()), key=str) == want


def test_link_counts_of_an_empty_table(spark):
    assert jaccard_join.near_duplicates(empty(spark), links=True).count() == 0


def test_overlaps(monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard_join, "COLUMNS", 7)
    draw = random.Random(8)
    for _ in range(50):
        x, y = ([np.unique(np.array([draw.randrange(60) for _ in range(draw.randint(1, 40))], dtype=np.uint64)) for _ in range(draw.randint(1, 6))] for _ in range(2))
        assert jaccard_join._overlaps(x, y).tolist() == [[len(np.intersect1d(s, t)) for t in y] for s in x]


def test_names_of_sets_depend_on_the_salt():
    import numpy as np

    h, doc, n = np.array([5, 9, 5, 9, 7], dtype=np.uint64), np.array([0, 0, 1, 1, 3]), np.array([2, 2, 0, 1])
    names = [jaccard_join._class_ids(h, doc, n, salt) for salt in range(3)]
    for sig, check in names:
        assert sig[0] == sig[1] != sig[3] and check[0] == check[1] != check[3] and sig[2] == check[2] == 0
    assert len({int(x[0]) for pair in names for x in pair}) == 6


def test_sets_that_share_a_name_are_named_anew(spark, monkeypatch):
    tried = []
    real = jaccard_join._documents

    def clash(found):
        tried.append(1)
        out = real(found)
        return out.withColumn("sig", jaccard_join.F.when(out.n_shingles > 0, 1).otherwise(0).cast("long")) if len(tried) < 3 else out

    monkeypatch.setattr(jaccard_join, "_documents", clash)
    rows = odd_rows()
    assert sorted((tuple(r) for r in jaccard_join.near_duplicates(documents(spark, rows)).collect()), key=str) == brute(rows)
    assert len(tried) == 3
