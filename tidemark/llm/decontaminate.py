"""Training documents that hold passages of benchmark items, exact or edited.

Seeds are the word n-grams of the benchmark items, case folded, all of them: a rarer
half would miss a copy whose rare seeds are edited or in the half that was not copied.
Seeds that a document shares with an item mark a stretch of the document, wide enough
for every alignment through them that reaches the least score, and Smith-Waterman
alignment (match 2, mismatch and gap -1) of stretch and item gives the score, as
a share of the best possible one.  A copy of which no ``SEED_WORDS`` words in a row are
left is not found.

The benchmark is handled in blocks of at most about ``block_items`` items and ``BLOCK_BYTES`` of
text, the only thing sent to all tasks; documents are never shuffled.

Results for odd input: null or empty texts and items match nothing; items shorter
than a seed are compared as one seed; repeated documents are reported each, repeated
items under each id; rows with a null id are passed over; empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.llm._spark import table

SEED_WORDS = 3
MIN_SCORE = 0.4
#: Benchmark items that are sent to all tasks at once.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
_SIEVE_BITS = 22


def _plain(texts: list[bytes]) -> list[bytes]:
    """Case folded, ASCII punctuation as blanks."""
    return [(t if t.isascii() else t.decode(errors="surrogateescape").casefold().encode(errors="surrogateescape")).translate(_PLAIN) for t in texts]


class Items:
    """A block of benchmark items: word hashes of each, and (seed, item, position) sorted by seed."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        keep = [i for i, t in enumerate(texts) if t and t.encode().translate(_PLAIN).split()]
        self.ids = [ids[i] for i in keep]
        self.words: list[np.ndarray] = []
        seeds, item, pos = [], [], []
        for chunk in _text.chunks(_plain([texts[i].encode() for i in keep])):
            for k, row in enumerate(chunk.rows):
                words = chunk.hash[chunk.first[k] : chunk.first[k + 1]]
                self.words.append(words)
                own = _text.rolling(words, min(SEED_WORDS, len(words)))
                seeds.append(own)
                item.append(np.full(len(own), row))
                pos.append(np.arange(len(own)))
        seed, item, pos = (np.concatenate(x) if x else np.empty(0, dtype=t) for x, t in ((seeds, np.uint64), (item, np.int64), (pos, np.int64)))
        order = np.lexsort((pos, item, seed))
        self.seed, self.item, self.pos = seed[order], item[order], pos[order]
        self.sieve = np.zeros(1 << _SIEVE_BITS, dtype=bool)
        self.sieve[self.seed & np.uint64((1 << _SIEVE_BITS) - 1)] = True
        self.short = sorted({len(w) for w in self.words if len(w) < SEED_WORDS})

    def hits(self, chunk: _text.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Seeds found in a chunk: hash, word, document (index in the chunk)."""
        found = [[], [], []]
        for width in [SEED_WORDS, *self.short]:
            h, at, doc = chunk.windows(width)
            maybe = np.flatnonzero(self.sieve[h & np.uint64((1 << _SIEVE_BITS) - 1)])
            k = np.minimum(np.searchsorted(self.seed, h[maybe]), len(self.seed) - 1)
            sure = maybe[self.seed[k] == h[maybe]]
            for out, x in zip(found, (h, at, doc), strict=True):
                out.append(x[sure])
        return tuple(np.concatenate(x) for x in found)


def align(item: np.ndarray, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of an item with each passage: best score, and the passage word after its end."""
    width = max(map(len, passages))
    words = np.zeros((len(passages), width), dtype=np.uint64)
    real = np.zeros((len(passages), width), dtype=bool)
    for i, p in enumerate(passages):
        words[i, : len(p)], real[i, : len(p)] = p, True
    ramp = np.arange(width, dtype=np.int32)
    row = np.zeros((len(passages), width), dtype=np.int32)
    best, end = np.zeros(len(passages), dtype=np.int32), np.zeros(len(passages), dtype=np.int64)
    for word in item:
        left = np.zeros_like(row)
        left[:, 1:] = row[:, :-1]
        now = np.maximum(left + np.where(real & (words == word), 2, -1), row - 1)
        now = np.maximum(now, 0)
        row = np.maximum.accumulate(now + ramp, axis=1) - ramp
        at = row.argmax(axis=1)
        top = row[np.arange(len(row)), at]
        end = np.where(top > best, at + 1, end)
        best = np.maximum(best, top)
    return best, end


def _stretches(diagonals: np.ndarray, n_item: int, n_doc: int, min_score: float) -> list[tuple[int, int]]:
    """Word ranges of a document around seed hits, given document minus item positions.

    An alignment that reaches the score has at most 2 * n_item * (1 - min_score) gaps.
    """
    slack = 1 + int(2 * n_item * (1 - min_score))
    d = np.unique(diagonals)
    cut = np.flatnonzero(np.diff(d) > slack) + 1
    return [(max(0, int(g[0]) - slack), min(n_doc, int(g[-1]) + n_item + slack)) for g in np.split(d, cut)]


def _leaks(texts: list[bytes], items: Items, min_score: float) -> list[tuple[int, int, float, int]]:
    """(row, item, score, end word) of the best alignment of each row and item that reaches the score."""
    out = []
    for chunk in _text.chunks(_plain(texts)):
        h, at, doc = items.hits(chunk)
        if not len(h):
            continue
        lo, hi = np.searchsorted(items.seed, h, "left"), np.searchsorted(items.seed, h, "right")
        each = np.repeat(np.arange(len(h)), hi - lo)
        k = np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[each]
        item, diagonal, doc = items.item[k], (at[each] - chunk.first[doc[each]]) - items.pos[k], doc[each]
        order = np.lexsort((diagonal, doc, item))
        item, diagonal, doc = item[order], diagonal[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]))))
        by_item = defaultdict(list)
        for a, b in zip(first, np.append(first[1:], len(item)), strict=True):
            d, words = int(doc[a]), items.words[item[a]]
            begin, n = int(chunk.first[d]), int(chunk.first[d + 1] - chunk.first[d])
            by_item[int(item[a])] += [(d, s, chunk.hash[begin + s : begin + e]) for s, e in _stretches(diagonal[a:b], len(words), n, min_score)]
        for i, found in by_item.items():
            found.sort(key=lambda x: len(x[2]))
            best: dict[int, tuple[int, int]] = {}
            for k in range(0, len(found), 256):
                group = found[k : k + 256]
                for (d, s, _), score, end in zip(group, *align(items.words[i], [p for *_, p in group]), strict=True):
                    best[d] = max(best.get(d, (-1, 0)), (int(score), -(s + int(end))))
            for d, (score, end) in best.items():
                if score >= min_score * 2 * len(items.words[i]):
                    out.append((chunk.rows[d], items.ids[i], score / (2 * len(items.words[i])), -end))
    return out


def _blocks(benchmark: DataFrame, block_items: int):
    """Blocks of the benchmark."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null")
    count, size = items.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()
    n = max(-(-count // (block_items // 2 + 1)), -(-(size or 0) // (BLOCK_BYTES // 2)))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        block = Items([r.item_id for r in rows], [r.text for r in rows])
        if block.ids:
            yield block


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, end_word): documents that hold an item's passage; score from min_score to 1."""
    schema = "doc_id long, item_id long, score double, end_word long"
    ids = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    found = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark, block_items):

        def search(batches, block=block):
            for batch in _text.sliced(batches):
                got = _leaks(_text.utf8(batch.column("text")), block, min_score)
                row, item, score, end = zip(*got, strict=True) if got else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(end, pa.int64())], ["doc_id", "item_id", "score", "end_word"])

        found = found.unionAll(ids.mapInArrow(search, schema))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows that hold no benchmark passage, with all their columns."""
    schema = docs.schema
    for block in list(_blocks(benchmark, block_items)):

        def clean(batches, block=block):
            for batch in _text.sliced(batches):
                bad = {x[0] for x in _leaks(_text.utf8(batch.column(batch.schema.get_field_index("text"))), block, min_score)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(clean, schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
