"""Documents to training shards: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, mixture, quality_rules, shards
from tidemark.llm._spark import BROADCAST_ROWS, saved, small, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the likelihood ratio.

    Null, empty and short texts fail the base rule; rows that repeat are judged alike; without labels of
    both kinds the base rule alone decides; an empty table stays empty.
    """
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest doc_id, of several texts under it one, and once if it is repeated.

    Rows with a null doc_id are not compared and stay.
    """
    found = jaccard_join.near_duplicates(docs, keys=True).where("doc_id is not null")
    grouped = found.where("family is not null").select("family", F.struct("doc_id", "row").alias("own"))
    first = saved(grouped.groupBy("family").agg(F.min("own").alias("first")))
    others = saved(grouped.join(small(first), "family").where("own <> first").select(F.col("own.doc_id").alias("other_id"), F.col("own.row").alias("other_row")).distinct())
    # the rows to drop are sent to all tasks only while they are few; else both sides are shuffled
    drop = F.broadcast(others) if others.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else others
    same = (docs["doc_id"].cast("long") == drop["other_id"]) & (jaccard_join.row_key(docs) == drop["other_row"])
    kept = docs.join(drop, same, "left_anti").select(*docs.columns)
    twice = saved(found.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not twice.limit(1).count():
        return kept
    again = kept.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Null and empty texts and items match nothing; rows that repeat go or stay together, with or without an
    id; an empty table of either kind drops nothing.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen by the raked probabilities of their cells.

    Null sources and languages are classes of their own; null and blank texts count no tokens; rows of one
    doc_id, or without any, are chosen alike within a cell; an empty table stays empty.
    """
    return mixture.choose(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document.

    A null text has size 8; rows that repeat, or have no id, take slots of their own; an empty table gives
    no rows.
    """
    return shards.assign(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The quality model, the alignment scores and the ring are not expressible in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
