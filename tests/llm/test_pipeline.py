import math
import random
import uuid
from collections import Counter

import duckdb
import pytest
from helpers import documents, empty, odd_rows, prose
from test_decontaminate import swipe
from test_jaccard import shingles
from test_quality import brute as base_rule

import corpus_pipeline
from tidemark.llm import decontaminate, mixture, quality_rules
from tidemark.llm._spark import shared_dir

DATA = "/root/testdata/sf0.001"


def test_stages_on_real_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.saved(stage(spark, docs, DATA))
        assert out.columns == docs.columns, name
        ids, before = ({r.doc_id for r in x.select("doc_id").collect()} for x in (out, docs))
        assert ids <= before
        docs = out
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == seen[-1]
    assert corpus_pipeline.run(spark, DATA).count() == seen[-1]


def corpus():
    """Odd rows, families of copies, labelled rows of both kinds, leaks of benchmark items."""
    draw = random.Random(21)
    good = [(1000 + k, prose(1000 + k, 60 + k), "en", f"s{k % 3}") for k in range(40)]
    bad = [(2000 + k, " | ".join(prose(2000 + k, 70).split()) + " ###", "de", "s0") for k in range(20)]
    copies = [(3000 + k, near(prose(3000, 90), draw.randrange(90)), "fr", "s1") for k in range(15)]
    items = [(k, prose(500 + k, 30)) for k in range(6)] + [(90, None), (91, "")]
    leaks = [(4000 + k, f"{prose(4100 + k, 40)} {near(t, 7).upper()} {prose(4200 + k, 40)}", "en", "s2") for k, t in items[:6]]
    labels = [(i, 1, 0) for i, *_ in good[:30]] + [(i, 0, 0) for i, *_ in bad[:15]] + [(None, 1, 1), (1001, None, 0), (15, 1, 0)]
    return odd_rows() + good + bad + copies + leaks, labels, items


def near(text, k):
    w = text.split()
    return " ".join([*w[:k], "changed", *w[k + 1 :]])


@pytest.fixture
def folder(spark):
    """A table folder with the labels and the benchmark of the corpus."""
    _, labels, items = corpus()
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def good_rows(rows, labels):
    """What the quality stage keeps, worked out with counters."""
    labels = {i: q for i, q, _ in sorted(((i, q, 0) for i, q, _ in labels if i is not None and q is not None), reverse=True)}

    def buckets(text):
        raw = b" ".join((text or "").encode().split())
        return [(int.from_bytes(raw[k : k + 4], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for k in range(len(raw) - 3)]

    grams = [Counter(buckets(t)) for _, t, *_ in rows]
    raw, target = sum(grams, Counter()), sum((g for g, (i, *_) in zip(grams, rows, strict=True) if labels.get(i) == 1), Counter())
    size = quality_rules.BUCKETS
    ratio = {k: round(math.log((target[k] + 0.5) / (target.total() + 0.5 * size) / ((raw[k] + 0.5) / (raw.total() + 0.5 * size))) * 2**20) for k in raw}
    score = [sum(n * ratio[k] for k, n in g.items()) / max(1, g.total()) / 2**20 for g in grams]
    failed = [base_rule(t)[-1] for _, t, *_ in rows]
    known = {}
    for (i, *_), x, f in zip(rows, score, failed, strict=True):
        if i in labels and not f:
            known[i] = min(known.get(i, x), x)
    steps = sorted(set(known.values()))
    gain = [sum(1 if labels[i] == 0 else -quality_rules.GOOD_WEIGHT for i, x in known.items() if x <= step) for step in steps]
    k = max(range(len(steps)), key=lambda k: (gain[k], -k))
    threshold = -math.inf if gain[k] <= 0 else steps[k] if k + 1 == len(steps) else (steps[k] + steps[k + 1]) / 2
    return [r for r, x, f in zip(rows, score, failed, strict=True) if not f and x > threshold]


def first_of_families(rows):
    """One row of each family of near copies, repeated rows once, rows without an id all."""
    out, seen = [r for r in rows if r[0] is None], []
    for r in sorted({r[:4] for r in rows if r[0] is not None}, key=lambda r: (r[0], str(r[1]))):
        seen.append((r, shingles(r[1])))
    up = list(range(len(seen)))
    for x in range(len(seen)):
        for y in range(x):
            a, b = seen[x][1], seen[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                old, new = up[x], up[y]
                up = [new if u == old else u for u in up]
    return out, [[seen[k][0] for k in range(len(seen)) if up[k] == name] for name in sorted(set(up))]


def keyed(rows):
    return Counter((r[0], r[1]) for r in rows)


@pytest.mark.parametrize("shuffled", [False, True])
def test_stages_against_brute_force(spark, folder, shuffled):
    rows, labels, items = corpus()
    quality, duplicates, leaks, mixing, sharding = (stage for _, stage in corpus_pipeline.STAGES)
    docs = documents(spark, rows)
    docs = docs.repartition(5) if shuffled else docs

    def result(stage):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        return keyed(out.select("doc_id", "text").collect())

    assert result(quality) == keyed(good_rows(rows, labels))
    alone, families = first_of_families(rows)
    got = result(duplicates)
    assert sum(got.values()) == len(alone) + len(families)
    for members in families:
        least = min(r[0] for r in members)
        assert sum(got[r[:2]] for r in members if r[0] == least) == 1 and not any(got[r[:2]] for r in members if r[0] != least)
    assert all(got[r[:2]] >= 1 for r in alone)
    bad = {(i, t) for i, t, *_ in rows if any(k is not None for k in found_items(t, items))}
    assert len(bad) == 6 and result(leaks) == keyed(r for r in rows if r[:2] not in bad)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}))
    assert {i for i, _ in result(mixing)} == {r[0] for r in con.sql(f"SELECT doc_id FROM ({mixture.ORACLE}) WHERE chosen").fetchall()}
    placed = sharding(spark, docs, folder).collect()
    loads = Counter(r.shard for r in placed)
    assert len(placed) == len(rows) and max(loads.values()) - min(loads.values()) <= 1
    assert sorted((r.shard, r.slot) for r in placed) == [(s, k) for s in sorted(loads) for k in range(loads[s])]


def found_items(text, items):
    plain = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").casefold()).split()
    words = plain(text)[:500]  # the items of this corpus stand early in their texts
    return [k for k, item in items if plain(item) and swipe(plain(item), words) >= decontaminate.MIN_SCORE * 2 * len(plain(item))]


def test_no_rows_in_every_stage(spark, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), folder).count() == 0


def test_one_of_each_group_stays(spark):
    rows = corpus_pipeline.near_duplicates(spark, documents(spark), DATA).collect()
    ids = [r.doc_id for r in rows]
    assert 1 in ids and 2 not in ids and 3 not in ids and 7 in ids and 8 not in ids and 9 not in ids
    assert ids.count(15) == 2 and None in ids and {4, 5, 6} <= set(ids)


def test_queries_are_registered():
    from tidemark.llm.queries import ORACLE, QUERIES

    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 11)) and set(ORACLE) <= set(QUERIES)


def test_texts_that_share_a_doc_id(spark):
    base, other, alone = prose(31, 120), prose(32, 120), prose(33, 120)
    near = lambda t: t.replace(t.split()[50], "changed")
    texts = [(1, base), (2, near(base)), (2, alone), (3, other), (3, near(other)), (4, None), (4, ""), (4, "")]
    rows = corpus_pipeline.near_duplicates(spark, documents(spark, [(*t, "en", "s") for t in texts]), DATA).collect()
    got = [(r.doc_id, r.text) for r in rows]
    assert (1, base) in got and (2, alone) in got and (2, near(base)) not in got
    assert sum(i == 3 for i, _ in got) == 1 and sorted(str(x) for x in got if x[0] == 4) == ["(4, '')", "(4, None)"]
    assert len(got) == 5
