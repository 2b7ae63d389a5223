import os
import random

import pytest
from helpers import documents, empty, odd_rows, words

from tidemark.llm import token_count


def greedy(initial, further, word):
    n = at = 0
    while at < len(word):
        pieces = further if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_against_greedy_matching():
    draw = random.Random(2)
    piece = lambda: bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 4)))
    for _ in range(500):
        initial, further = ({piece() for _ in range(draw.randint(1, 8))} for _ in range(2))
        own = token_count.LongestMatch(initial, further)
        for _ in range(10):
            word = bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 10)))
            assert own.count(word) == greedy(initial, further, word)


def test_marked_pieces():
    own = token_count.marked(["un", "##aff", "##able", "##a", "b"])
    assert [own.count(w) for w in (b"unaffable", b"una", b"b", b"x", b"bx")] == [3, 2, 1, 1, 1]


@pytest.mark.skipif(not os.path.exists(token_count.VOCABULARY), reason="no public vocabulary here")
def test_documents(spark):
    pieces = token_count.read_ranks(token_count.VOCABULARY)
    initial, further = {p for p in pieces if p[:1] == b" "}, {p for p in pieces if p[:1] != b" "}
    got = token_count.token_counts(documents(spark).where("length(text) < 5000 or text is null"), token_count.byte_level(pieces)).collect()
    want = [(i, len(words(t)), sum(greedy(initial, further, b" " + w) for w in words(t))) for i, t, *_ in odd_rows() if len(t or "") < 5000]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert token_count.token_counts(empty(spark), token_count.byte_level(pieces)).count() == 0
