"""Quality verdicts: fixed text statistics and a hashed n-gram likelihood ratio.

Two multinomials over ``BUCKETS`` hashed byte n-grams are estimated: one from
trusted documents (labelled quality 1), one from the whole raw corpus.  A document's
score is the mean log ratio of its n-grams, in fixed point so that sums
do not depend on how rows are grouped.  The threshold is set once, from labelled
documents, and then applied to every document.

Labelled rows are a sample of at most ``max_labels`` good and as many bad ones (those
with the smallest id hash); the raw corpus is counted whole.

Results for odd input: null and empty texts have zero statistics, fail
the base rule and are not kept; without labelled rows of both kinds every
document that passes the base rule is kept; repeated rows are judged alike; an
empty table gives an empty result; extra columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.llm._spark import saved, table

BUCKETS = 1 << 16
GRAM_BYTES = 4
#: Labelled rows of either kind that the model may use.
MAX_LABELS = 50_000
#: Bad documents that must be caught for each good one lost.
GOOD_WEIGHT = 5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SCALE = 1 << 20

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


@dataclass(frozen=True)
class QualityModel:
    """log_ratio: fixed-point log ratio of each bucket; threshold: a document must score above it."""

    log_ratio: np.ndarray
    threshold: float


def _buckets(chunk: _text.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of a chunk, and the bounds of each document's n-grams."""
    raw = chunk.bytes.astype(np.uint32)
    n = len(raw) - GRAM_BYTES + 1
    lengths = _lengths(chunk)
    begin = np.cumsum(lengths + 1) - lengths - 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.zeros(len(lengths) + 1, dtype=np.int64)
    gram = raw[:n].copy()
    for k in range(1, GRAM_BYTES):
        gram |= raw[k : n + k] << np.uint32(8 * k)
    bucket = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    size = np.maximum(lengths - GRAM_BYTES + 1, 0)
    inside = np.zeros(len(raw) + 1, dtype=np.int32)
    np.add.at(inside, begin[size > 0], 1)
    np.add.at(inside, (begin + size)[size > 0], -1)
    return bucket[np.cumsum(inside[:n]) > 0], np.concatenate(([0], np.cumsum(size)))


def _lengths(chunk: _text.Chunk) -> np.ndarray:
    ends = np.flatnonzero(chunk.bytes == 10)
    return np.diff(np.concatenate(([-1], ends))) - 1


def _per_document(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of a value per byte over each document (the newline after it included)."""
    sums = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(lengths + 1)
    return sums[ends] - sums[ends - lengths - 1]


def _repeat_words(chunk: _text.Chunk) -> np.ndarray:
    """Words inside 3-word windows that the same document has twice or more."""
    hashes, at, doc = chunk.windows(3)
    covered = np.zeros(len(chunk.hash) + 1, dtype=np.int64)
    if len(hashes):
        key = _text.mix(hashes + _text.mix(doc.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + 3, -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))
    return inside[chunk.first[1:]] - inside[chunk.first[:-1]]


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = {k: np.zeros(len(texts), dtype=np.int64) for k in names}
    for chunk in _text.chunks(texts):
        rows, lengths = np.asarray(chunk.rows), _lengths(chunk)
        out["n_words"][rows] = chunk.counts
        letter = ((chunk.bytes & 0xC0) != 0x80) & (chunk.bytes != 32) & (chunk.bytes != 10)
        out["word_chars"][rows] = _per_document(letter.astype(np.int64), lengths)
        out["n_symbols"][rows] = _per_document(_SYMBOL[chunk.bytes], lengths)
        out["n_repeat_words"][rows] = _repeat_words(chunk)
    out["n_dup_lines"][:] = [_dup_lines(t) for t in texts]
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    return out


def _scores(texts: list[bytes], log_ratio: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for chunk in _text.chunks(texts):
        bucket, bounds = _buckets(chunk)
        sums = np.concatenate(([0], np.cumsum(log_ratio[bucket])))
        total, n = sums[bounds[1:]] - sums[bounds[:-1]], np.diff(bounds)
        out[np.asarray(chunk.rows)] = total / np.maximum(n, 1) / _SCALE
    return out


def _counted(docs: DataFrame) -> np.ndarray:
    """n-gram counts of all rows; one vector of BUCKETS numbers reaches the driver."""

    def count(batches):
        have = np.zeros(BUCKETS, dtype=np.int64)
        for batch in _text.sliced(batches):
            for chunk in _text.chunks(_text.utf8(batch.column(0))):
                have += np.bincount(_buckets(chunk)[0], minlength=BUCKETS)
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(have[at])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, good_weight: int = GOOD_WEIGHT) -> QualityModel:
    """Estimate both multinomials and the threshold."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    labels = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = lambda q: labels.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    sample = saved(some(1).unionAll(some(0)))
    marked = saved(docs.join(F.broadcast(sample), "doc_id"))
    raw, target = _counted(docs), _counted(marked.where("quality = 1"))
    if not target.sum():
        return QualityModel(np.zeros(BUCKETS, dtype=np.int64), -1.0)
    p, q = (target + 0.5) / (target.sum() + 0.5 * BUCKETS), (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    log_ratio = np.rint(np.log(p / q) * _SCALE).astype(np.int64)

    def judged(batches):
        for batch in _text.sliced(batches):
            texts = _text.utf8(batch.column("text"))
            keep = ~_statistics(texts)["base_failed"]
            columns = [batch.column("doc_id"), pa.array(_scores(texts, log_ratio)), batch.column("quality")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "quality"]).filter(pa.array(keep))

    # a row for each labelled doc_id, 2 * max_labels at most, however often it repeats
    known = marked.mapInArrow(judged, "doc_id long, score double, quality int").groupBy("doc_id").agg(F.min("score").alias("score"), F.min("quality").alias("quality")).toArrow()
    return QualityModel(log_ratio, _threshold(known.column("score").to_numpy(), known.column("quality").to_numpy(), good_weight))


def _threshold(scores: np.ndarray, quality: np.ndarray, good_weight: int) -> float:
    """Below it lie the labelled documents for which (bad - good_weight * good) is largest."""
    if not len(scores):
        return float("-inf")
    order = np.argsort(scores, kind="stable")
    s, gain = scores[order], np.cumsum(np.where(quality[order] == 0, 1, -good_weight))
    ends = np.append(s[1:] != s[:-1], True)
    best = int(np.argmax(np.where(ends, gain, np.iinfo(np.int64).min)))
    if gain[best] <= 0:
        return float("-inf")
    return float(s[best] if best + 1 == len(s) else (s[best] + s[best + 1]) / 2)


_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Per document: doc_id, the statistics, base_failed, score, kept."""

    def verdicts(batches):
        for batch in _text.sliced(batches):
            texts = _text.utf8(batch.column("text"))
            out = _statistics(texts)
            out["score"] = _scores(texts, model.log_ratio)
            out["kept"] = ~out["base_failed"] & (out["score"] > model.threshold)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v) for v in out.values())], ["doc_id", *out])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(verdicts, f"doc_id long, {_COLUMNS}")


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows that the model keeps, with all their columns."""

    def good(batches):
        for batch in _text.sliced(batches):
            texts = _text.utf8(batch.column(batch.schema.get_field_index("text")))
            kept = ~_statistics(texts)["base_failed"] & (_scores(texts, model.log_ratio) > model.threshold)
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(good, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


_GRAM = " + ".join(f"CAST('0x' || substr(g, {2 * k + 1}, 2) AS BIGINT) * {1 << 8 * k}" for k in range(GRAM_BYTES))
_PAIRS = " || ".join(f"h[i + {k}]" for k in range(GRAM_BYTES))
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
tri AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 2], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM tri) WHERE times > 1) GROUP BY doc_id),
b AS MATERIALIZED (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d) d LEFT JOIN rep ON rep.doc_id = d.doc_id),
f AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
x AS (SELECT doc_id, regexp_extract_all(hex(encode(array_to_string(w, ' '))), '..') AS h FROM d),
each AS MATERIALIZED (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, {_PAIRS} AS g FROM (SELECT doc_id, h, unnest(range(1, len(h) - {GRAM_BYTES - 2})) AS i FROM x WHERE len(h) >= {GRAM_BYTES})) GROUP BY doc_id, g),
names AS MATERIALIZED (SELECT g, CAST((({_GRAM}) * {0x9E3779B1}::HUGEINT % {1 << 32}) // {1 << 16} AS BIGINT) AS bucket FROM (SELECT DISTINCT g FROM each)),
grams AS MATERIALIZED (SELECT doc_id, bucket, CAST(sum(n) AS BIGINT) AS n FROM each JOIN names ON names.g = each.g GROUP BY doc_id, bucket),
l AS MATERIALIZED (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id),
c AS (SELECT bucket, coalesce(raw, 0) AS raw, coalesce(good, 0) AS good FROM (SELECT unnest(range({BUCKETS})) AS bucket) LEFT JOIN (
  SELECT bucket, sum(n) AS raw, sum(n) FILTER (quality = 1) AS good FROM grams LEFT JOIN l ON l.doc_id = grams.doc_id GROUP BY bucket) USING (bucket)),
v AS MATERIALIZED (SELECT bucket, CAST(round_even(ln(((good + 0.5::DOUBLE) / (sum(good) OVER () + 0.5::DOUBLE * {BUCKETS})) / ((raw + 0.5::DOUBLE) / (sum(raw) OVER () + 0.5::DOUBLE * {BUCKETS}))) * {_SCALE}, 0) AS BIGINT) AS ratio FROM c),
m AS MATERIALIZED (SELECT doc_id, CAST(sum(n * ratio) AS DOUBLE) / CAST(sum(n) AS DOUBLE) / {_SCALE} AS score FROM grams JOIN v ON v.bucket = grams.bucket GROUP BY doc_id),
known AS (SELECT coalesce(score, 0.0::DOUBLE) AS score, quality FROM l JOIN f ON f.doc_id = l.doc_id LEFT JOIN m ON m.doc_id = l.doc_id WHERE NOT base_failed),
gain AS (SELECT score, sum(sum(CASE quality WHEN 0 THEN 1 ELSE -{GOOD_WEIGHT} END)) OVER (ORDER BY score) AS gain, lead(score) OVER (ORDER BY score) AS next FROM known GROUP BY score),
cut AS (SELECT CASE WHEN gain > 0 THEN coalesce((score + next) / 2, score) ELSE '-inf'::DOUBLE END AS threshold FROM gain ORDER BY gain DESC, score LIMIT 1)
SELECT f.*, coalesce(score, 0.0::DOUBLE) AS score, NOT base_failed AND coalesce(score, 0.0::DOUBLE) > coalesce((SELECT threshold FROM cut), '-inf'::DOUBLE) AS kept FROM f LEFT JOIN m ON m.doc_id = f.doc_id
"""
