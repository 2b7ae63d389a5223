import duckdb
from helpers import documents, empty, odd_rows, prose

from tidemark.llm import mixture


def test_against_sql(spark):
    rows = odd_rows() + [(1000 + k, prose(k, 20 + k * 3 % 700) + (" | x" if k % 9 == 0 else " ###" if k % 11 == 0 else ""), ["en", "de", "fr"][k % 3], f"src{k % 7 if k % 4 else 0}") for k in range(400)]
    docs = documents(spark, rows)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(mixture.ORACLE)
    got = mixture.probabilities(docs)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))
    chosen = mixture.choose(docs)
    assert chosen.columns == docs.columns and chosen.count() == got.where("chosen").count()


def test_targets_are_met(spark):
    rows = [(k, prose(k, 100), "en" if k % 5 else "de", f"s{k % 3 if k % 2 else 0}") for k in range(300)]
    docs = documents(spark, rows)
    p = mixture.probabilities(docs, budget=0.2, targets={"source": 0.0, "lang": {"en": 0.5, "de": 0.5}, "topic": 1.0}, rounds=25).collect()
    total = sum(r.n_tokens for r in p)
    for key, n in (("source", 3), ("lang", 2)):
        sums = {}
        for r in p:
            sums[r[key]] = sums.get(r[key], 0) + r.n_tokens * r.p
        assert all(abs(v / total - 0.2 / n) < 0.004 for v in sums.values())


def test_empty_and_topic_column(spark):
    assert mixture.probabilities(empty(spark)).count() == 0 and mixture.choose(empty(spark)).count() == 0
    docs = documents(spark).selectExpr("*", "'t' AS topic")
    assert {r.topic for r in mixture.probabilities(docs).collect()} == {"t"}
