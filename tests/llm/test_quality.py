import re
from collections import Counter

import numpy as np
from helpers import documents, empty, odd_rows, prose

from tidemark.llm import quality_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n, inside = Counter(three), set()
    for k, x in enumerate(three):
        if n[x] > 1:
            inside |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def labelled(spark):
    good = [(1000 + k, prose(1000 + k, 60 + k), "en", "s") for k in range(40)]
    bad = [(2000 + k, " | ".join(prose(2000 + k, 70).split()) + " ###", "en", "s") for k in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good[:30]] + [(i, 0, 0) for i, *_ in bad[:15]] + [(None, 1, 1), (1, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    return good, bad, labels


def test_statistics_and_verdicts(spark):
    good, bad, labels = labelled(spark)
    rows = odd_rows() + good + bad
    docs = documents(spark, rows).repartition(3)
    model = quality_rules.fit(docs, labels)
    got = quality_rules.judge(docs, model).collect()
    want = sorted(((i, *brute(t)) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i, *_ in good) and not any(kept[i] for i, *_ in bad)
    assert not any(r.kept and r.base_failed for r in got)
    again = quality_rules.judge(docs.repartition(7), model).collect()
    assert {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in got}
    left = quality_rules.keep_good(docs, model)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in got)


def test_scores_are_mean_log_ratios():
    table = np.arange(quality_rules.BUCKETS, dtype=np.int64) << 20
    text = "déjà  vu\nencore"
    raw = b" ".join(text.encode().split())
    grams = [int.from_bytes(raw[k : k + 4], "little") for k in range(len(raw) - 3)]
    want = np.mean([(g * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for g in grams])
    assert quality_rules._scores([b"", text.encode(), b"ab"], table).tolist() == [0.0, want, 0.0]


def test_without_labels_and_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark)
    got = quality_rules.judge(docs, quality_rules.fit(docs, none)).collect()
    assert all(r.kept != r.base_failed for r in got)
    assert quality_rules.judge(empty(spark), quality_rules.fit(empty(spark), none)).count() == 0
