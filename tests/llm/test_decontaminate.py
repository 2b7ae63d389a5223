import random

import numpy as np
import pytest
from helpers import documents, empty, odd_rows, prose

from tidemark.llm import decontaminate


def edited(text, rate, draw):
    out = []
    for w in text.split():
        u = draw.random()
        out += [prose(draw.random(), 1)] if u < rate / 2 else [] if u < rate * 0.75 else [w, prose(draw.random(), 1)] if u < rate else [w]
    return " ".join(out)


def swipe(item, passage):
    best = 0
    row = [0] * (len(passage) + 1)
    for a in item:
        new = [0]
        for j, b in enumerate(passage):
            new.append(max(0, row[j] + (2 if a == b else -1), row[j + 1] - 1, new[j] - 1))
        row = new
        best = max(best, max(row))
    return best


def test_alignment():
    draw = random.Random(1)
    for _ in range(60):
        item = np.array([draw.randrange(1, 6) for _ in range(draw.randint(1, 12))], dtype=np.uint64)
        passages = [np.array([draw.randrange(1, 6) for _ in range(draw.randint(1, 20))], dtype=np.uint64) for _ in range(4)]
        assert decontaminate.align(item, passages)[0].tolist() == [swipe(item.tolist(), p.tolist()) for p in passages]


@pytest.mark.parametrize("block", [1, 20_000])
def test_copies_and_clean_texts(spark, block):
    draw = random.Random(4)
    items = [(k, prose(500 + k, 25 + k), ) for k in range(12)]
    leaks = [(300 + k, f"{prose(700 + k, 40)} {edited(t, (k % 3) * 0.1, draw).upper()}, {prose(800 + k, 40)}", "en", "s") for k, t in items]
    clean = [(400 + k, prose(900 + k, 100), "en", "s") for k in range(30)]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (None, "one two three"), (92, "zebra quagga")], "item_id long, text string")
    docs = documents(spark, odd_rows() + leaks + clean).repartition(3)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, block_items=block).collect()}
    assert got == {(300 + k, k) for k, _ in items}
    left = decontaminate.drop_leaks(docs, bench, block_items=block)
    assert left.columns == docs.columns and left.count() == docs.count() - len(items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(documents(spark), none).count() == 0
    some = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    assert decontaminate.leaks(empty(spark), some).count() == 0


def brute(rows, items):
    plain = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").casefold()).split()
    pairs = ((d, plain(t), k, plain(s)) for d, t in rows for k, s in items)
    scores = {(d, k): swipe(s, t) / (2 * len(s)) for d, t, k, s in pairs if s}
    return {x: s for x, s in scores.items() if s >= decontaminate.MIN_SCORE}


def test_edited_and_partial_copies_against_brute_force(spark):
    draw = random.Random(11)
    items = [(k, prose(1500 + k, 30) + " çà être Élan") for k in range(12)]
    texts = [edited(t, rate, draw) for _, t in items for rate in (0.2, 0.25, 0.3, 0.35)]
    for k, (_, t) in enumerate(items):
        w = t.split()
        texts += [" ".join(w[: len(w) // 2])] * (3 * (k % 2))  # of every second item the first half leaked often
        texts += [" ".join(w[-(len(w) // 2) :]), edited(t, 0.2, draw).upper(), " ".join(w[:14] + prose(1700 + k, 20).split() + w[14:28])]
    rows = [(k, f"{prose(1800 + k, 15)} {t} {prose(1900 + k, 15)}") for k, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(documents(spark, [(*r, "en", "s") for r in rows]).repartition(3), bench).collect()
    want = brute(rows, items)
    assert len(want) > 90
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in got} == {x: round(s, 9) for x, s in want.items()}
