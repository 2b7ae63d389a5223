"""Word-piece token counts by a linear-time longest-match automaton.

The vocabulary becomes two tries, one of pieces that start a word and one of pieces
that continue it.  Every trie node gets a failure link to the node where matching
goes on once the greedy pieces of its string have been popped, and the number of
those pieces is precomputed, so a word is counted in one pass over its bytes and
no piece is ever built.

Results for odd input: a null or empty text has 0 words and 0 tokens; a word that
the vocabulary cannot cover counts as one unknown token; words of any length are
counted whole; repeated rows count alike; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections import Counter, deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.llm._spark import table

#: A public byte-level vocabulary; in it a leading blank marks a piece that starts a word.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose counts a task remembers, and their greatest length in bytes.
CACHE_WORDS, CACHE_BYTES = 500_000, 64


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a rank file: one base64 piece and its number on a line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch:
    """Greedy longest-match piece counts of words.

    initial: pieces that may start a word; further: pieces that may continue it.
    """

    def __init__(self, initial: Iterable[bytes], further: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]  # node 0: start of a word, node 1: inside
        self.fail: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        ends: set[int] = set()
        for root, pieces in ((0, initial), (1, further)):
            for piece in pieces:
                if not piece:
                    continue
                node = root
                for byte in piece:
                    step = self.next[node].get(byte)
                    if step is None:
                        step = self.next[node][byte] = len(self.next)
                        self.next.append({})
                        self.fail.append(-1)
                        self.popped.append(0)
                    node = step
                ends.add(node)
        self._link(ends)

    def _link(self, ends: set[int]) -> None:
        todo = deque((child, byte, root) for root in (0, 1) for byte, child in self.next[root].items())
        while todo:
            node, byte, parent = todo.popleft()
            if node in ends:
                self.fail[node], self.popped[node] = 1, 1
            else:
                at, n = self.fail[parent], self.popped[parent]
                while at >= 0 and byte not in self.next[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.next[at][byte], n
            todo.extend((child, b, node) for b, child in self.next[node].items())

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 (unknown) if it cannot be covered."""
        step, fail, popped = self.next, self.fail, self.popped
        node, n = 0, 0
        for byte in word:
            while byte not in step[node]:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = step[node][byte]
        while node > 1:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def byte_level(pieces: Iterable[bytes]) -> LongestMatch:
    """For vocabularies in which a blank in front marks the start of a word."""
    pieces = list(pieces)
    return LongestMatch([p for p in pieces if p.startswith(b" ")], [p for p in pieces if not p.startswith(b" ")])


def marked(pieces: Iterable[str], mark: str = "##") -> LongestMatch:
    """For vocabularies in which a mark in front shows that a piece continues a word."""
    pieces = list(pieces)
    return LongestMatch([p.encode() for p in pieces if not p.startswith(mark)], [p[len(mark) :].encode() for p in pieces if p.startswith(mark)])


def token_counts(docs: DataFrame, automaton: LongestMatch, lead: bytes = b" ") -> DataFrame:
    """Per document: doc_id, n_words, n_tokens; ``lead`` stands in front of every word."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)  # its size is the vocabulary's, whatever the input

    def counted(batches):
        one = shared.value.count
        known: dict[bytes, int] = {}
        for batch in _text.sliced(batches):
            n_words, n_tokens = [], []
            for text in _text.utf8(batch.column("text")):
                words = text.split()
                total = 0
                for word, times in Counter(words).items():
                    n = known.get(word)
                    if n is None:
                        n = one(lead + word)
                        if len(word) <= CACHE_BYTES:
                            if len(known) >= CACHE_WORDS:
                                known.clear()
                            known[word] = n
                    total += n * times
                n_words.append(len(words))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(counted, "doc_id long, n_words long, n_tokens long")


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), byte_level(read_ranks(VOCABULARY)))
