import re

import numpy as np
from helpers import thue_morse

from tidemark.llm import _text


def test_words_are_cut_at_six_bytes():
    text = "a\x0bb\x0cc\td\re f g\x1ch\x85i"
    chunk = next(_text.chunks([text.encode()]))
    assert chunk.counts.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", text))]


def test_hashes_depend_on_words_alone():
    texts = [b"alpha beta gamma", b"", b"beta gamma delta alpha beta", b"  gamma\n"]
    whole = list(_text.chunks(texts))
    single = [next(_text.chunks([t])).hash.tolist() for t in texts]
    joined = whole[0]
    assert [joined.hash[a:b].tolist() for a, b in zip(joined.first, joined.first[1:], strict=False)] == single
    hashes, at, doc = joined.windows(2)
    assert len(hashes) == 2 + 0 + 4 + 0 and hashes[0] == hashes[5] and hashes[1] == hashes[2]
    small = [c for c in _text.chunks(texts, limit=1)]
    assert [x for c in small for x in c.hash.tolist()] == [x for s in single for x in s]


def test_rolling_is_the_same_anywhere():
    values = _text.mix(np.arange(1000, dtype=np.uint64))
    assert (_text.rolling(values, 7)[500:] == _text.rolling(values[500:], 7)).all()


def test_no_family_of_words_collides():
    words = [w.encode() for size in (1, 2, 4, 8, 16, 32, 1024) for w in thue_morse(size)] + [b"a" * k for k in range(3, 40)] + [b"\x00" * k for k in range(1, 20)]
    words += [bytes([x, y]) * 4 for x in b"ab" for y in b"cd"]
    hashes = next(_text.chunks([b" ".join(words)])).hash
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))
    rows = [next(_text.chunks([w + b" x"])).hash[0] for w in words]
    assert rows == hashes.tolist()


def test_windows_differ_where_words_do():
    draw = np.random.default_rng(5)
    values = _text.mix(draw.integers(0, 4, 20_000).astype(np.uint64))
    seen = {}
    for h, x, key in zip(_text.rolling(values, 6).tolist(), _text.residue(values, 6, 2).tolist(), np.lib.stride_tricks.sliding_window_view(values, 6).tolist(), strict=True):
        assert seen.setdefault((h, x), key) == key
    assert len(seen) == len({tuple(k) for k in seen.values()})
