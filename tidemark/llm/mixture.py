"""Mixing of sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic) with token weights.  The cells
are raked: scaled in turn so that the token sums of every source, language and
topic meet their targets, and never above what a cell holds.  A document is chosen
with its cell's probability (raked weight over tokens), by a hash of its id.

Targets of a dimension are either shares by name (a class not named enters with its present
share, and all shares are then scaled to sum to one) or an exponent that flattens the sizes
found (1 keeps them, 0 makes them equal).  Only cells are raked; they are as many as
combinations of classes.  Counted cells of up to ``FEW_CELLS`` are raked in one partition, without
any exchange, more stay distributed by class.

The topic of a document is its column ``topic`` if it has one, else a class of
its form (table, markup, shout) or length (short, medium, long).

Results for odd input: null or blank texts have 0 tokens and the probability of their cell, or
``budget`` where all of the cell is blank; null classes are the class ""; repeated documents are chosen
alike; an empty table gives an empty result; extra columns are kept by ``choose`` and ignored by
``probabilities``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._spark import saved, small, table

#: Share of all tokens to keep.
BUDGET = 0.6
ROUNDS = 10
#: Cells (narrow rows) that one task rakes.
FEW_CELLS = 100_000
TARGETS: dict[str, float | dict[str, float]] = {"source": 0.5, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": 0.8}
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def _topic(docs: DataFrame, text: Column, n: Column) -> Column:
    if "topic" in docs.columns:
        return F.coalesce(F.col("topic").cast("string"), F.lit(""))
    return (
        F.when(text.contains(" | "), "table").when(text.rlike(r"[#*$%&]{3}"), "markup").when(text.contains("!! "), "shout")
        .when(n < 100, "short").when(n < 400, "medium").otherwise("long")
    )


def features(docs: DataFrame) -> dict[str, Column]:
    """Columns of a document's cell and weight, and its place in [0, 1)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = F.regexp_count(text, F.lit(WORD)).cast("long")
    place = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(f":{SEED}"))), 1, 8), 16, 10).cast("long")
    return {
        "mix_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "mix_tokens": n,
        "mix_topic": _topic(docs, text, F.col("mix_tokens")),
        "mix_place": place / F.lit(float(1 << 32)),
    }


def _with_features(docs: DataFrame) -> DataFrame:
    for name, column in features(docs).items():
        docs = docs.withColumn(name, column)
    return docs


def rake(rows: DataFrame, budget: float = BUDGET, targets: Mapping = TARGETS, rounds: int = ROUNDS) -> DataFrame:
    """(mix_source, mix_lang, mix_topic, mix_p) for rows that have the features."""
    keys = ["mix_source", "mix_lang", "mix_topic"]
    cells = rows.groupBy(*keys).agg(F.sum("mix_tokens").alias("tokens")).where("tokens > 0")
    cells = saved(cells)
    few = cells.limit(FEW_CELLS + 1).count() <= FEW_CELLS
    cells = cells.coalesce(1) if few else cells
    everything = Window.partitionBy(F.lit(0))
    for key in keys:
        goal = targets[key.removeprefix("mix_")]
        sizes = cells.groupBy(key).agg(F.sum("tokens").alias("size"))
        if isinstance(goal, Mapping):
            named = F.coalesce(*[F.when(F.col(key) == k, F.lit(float(v))) for k, v in goal.items()], F.col("size") / F.sum("size").over(everything))
        else:
            named = F.pow(F.col("size").cast("double"), F.lit(float(goal)))
        # a row for each class of one dimension
        share = sizes.withColumn("share", named).withColumn("share", F.col("share") / F.sum("share").over(everything))
        share = share.withColumn(f"to_{key}", F.col("share") * F.lit(float(budget)) * F.sum("size").over(everything))
        cells = cells.join(share.select(key, f"to_{key}"), key)
    kept = (lambda x: saved(x).coalesce(1)) if few else saved
    cells = kept(cells.withColumn("w", F.col("tokens") * F.lit(float(budget))))
    for k in range(rounds):
        if k and k % 5 == 0:
            cells = kept(cells)  # keeps the plan shallow
        for key in keys:
            cells = cells.withColumn("w", F.col("w") * F.col(f"to_{key}") / F.sum("w").over(Window.partitionBy(key)))
        cells = cells.withColumn("w", F.least("w", F.col("tokens").cast("double")))
    return saved(cells.select(*keys, F.round(F.col("w") / F.col("tokens"), 6).alias("mix_p")))


def _judged(rows: DataFrame, cells: DataFrame, budget: float) -> DataFrame:
    keys = ["mix_source", "mix_lang", "mix_topic"]
    return rows.join(small(cells), keys, "left").withColumn("mix_p", F.coalesce("mix_p", F.lit(float(budget)))).withColumn("mix_in", F.col("mix_place") < F.col("mix_p"))


def probabilities(docs: DataFrame, budget: float = BUDGET, targets: Mapping = TARGETS, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, source, lang, topic, n_tokens, p, chosen."""
    some = [c for c in ("doc_id", "source", "lang", "topic", "text") if c in docs.columns]
    rows = saved(_with_features(docs.select(*some)).select("doc_id", *(c for c in features(docs))))
    out = _judged(rows, rake(rows, budget, targets, rounds), budget)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_p").alias("p"), F.col("mix_in").alias("chosen"))


def choose(docs: DataFrame, budget: float = BUDGET, targets: Mapping = TARGETS, rounds: int = ROUNDS) -> DataFrame:
    """The chosen rows, with all their columns."""
    some = [c for c in ("doc_id", "source", "lang", "topic", "text") if c in docs.columns]
    rows = _with_features(docs.select(F.struct(*docs.columns).alias("whole"), *some))
    return _judged(rows, rake(rows, budget, targets, rounds), budget).where("mix_in").select("whole.*")


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probabilities(table(spark, sf_dir, "documents"))


def oracle(source: str = "documents", prefix: str = "") -> str:
    """DuckDB SQL: CTEs that end in ``{prefix}mixed`` with the columns of ``probabilities``."""
    dims = {"source": TARGETS["source"], "lang": TARGETS["lang"], "topic": TARGETS["topic"]}
    steps = [
        f"""{prefix}f AS (SELECT *, CASE WHEN contains(t, ' | ') THEN 'table' WHEN regexp_matches(t, '[#*$%&]{{3}}') THEN 'markup' WHEN contains(t, '!! ') THEN 'shout'
  WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 400 THEN 'medium' ELSE 'long' END AS topic FROM (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'none') || ':{SEED}'), 1, 8))::BIGINT / 4294967296.0 AS place FROM {source}))""",
        f"{prefix}c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM {prefix}f GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for key, goal in dims.items():
        size = "CAST(sum(tokens) AS DOUBLE)"
        if isinstance(goal, Mapping):
            share = "CASE " + " ".join(f"WHEN {key} = '{k}' THEN {float(v)!r}::DOUBLE" for k, v in goal.items()) + f" ELSE {size} / sum({size}) OVER () END"
        else:
            share = f"pow({size}, {float(goal)!r}::DOUBLE)"
        steps.append(f"{prefix}t_{key} AS (SELECT {key}, share / sum(share) OVER () * {BUDGET!r}::DOUBLE * sum(size) OVER () AS goal FROM (SELECT {key}, {size} AS size, {share} AS share FROM {prefix}c GROUP BY {key}))")
    steps.append(f"{prefix}w0 AS (SELECT source, lang, topic, tokens, a.goal AS to_source, b.goal AS to_lang, d.goal AS to_topic, tokens * {BUDGET!r}::DOUBLE AS w FROM {prefix}c JOIN {prefix}t_source a USING (source) JOIN {prefix}t_lang b USING (lang) JOIN {prefix}t_topic d USING (topic))")
    for k in range(ROUNDS):
        at = f"{prefix}w{k}"
        for key in dims:
            steps.append(f"{at}_{key} AS (SELECT * REPLACE (w * to_{key} / sum(w) OVER (PARTITION BY {key}) AS w) FROM {at})")
            at = f"{at}_{key}"
        steps.append(f"{prefix}w{k + 1} AS (SELECT * REPLACE (least(w, CAST(tokens AS DOUBLE)) AS w) FROM {at})")
    steps.append(f"{prefix}m AS (SELECT doc_id, f.source, f.lang, f.topic, n_tokens, place, coalesce(round(w / tokens, 6), {BUDGET!r}::DOUBLE) AS p FROM {prefix}f f LEFT JOIN {prefix}w{ROUNDS} w USING (source, lang, topic))")
    steps.append(f"{prefix}mixed AS (SELECT doc_id, source, lang, topic, n_tokens, p, place < p AS chosen FROM {prefix}m)")
    return ",\n".join(steps)


ORACLE = f"WITH {oracle()}\nSELECT * FROM mixed"
