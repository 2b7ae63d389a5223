"""Fixed cases and laws of codecs, ranges and policies."""

import random
import zlib

from pyspark.sql import functions as F

from tidemark.functions import attributes, codec
from tidemark.operators import intervals, policy
from tidemark.functions.checksum import crc32c


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_describe_keys(spark):
    lit = F.lit
    raw = F.substring(codec.key("INODE", lit(7)), 1, 7)
    got = one(
        spark, extent=codec.describe(codec.key("EXTENT", lit(7), lit(99))), seg=codec.describe(codec.key("SEGCOUNT", lit(4), lit(17))), stone=codec.describe(codec.key("TOMBSTONE", lit(5), lit(6))),
        none=codec.describe(lit(b"")), other=codec.describe(lit(b"xyz")), wrong=codec.describe(F.unhex(F.lit("6D657461FE" + "00" * 16))), cut=codec.describe(raw), kind=codec.kind_of(raw), name=codec.describe(codec.key("DIR_ENTRY", lit(3), name=lit("a b"))),
        sub=codec.describe(codec.system_key(2)),
    )
    assert got.extent == "inode_id=7, extent_index=99" and got.seg == "epoch=4, counter=17" and got.stone == "timestamp=5, inode_id=6"
    assert got.none is None and got.other is None and got.wrong is None
    assert got.kind == "INODE" and got.cut.startswith("raw=6D65746101") and got.name == 'dir_id=3, name="a b"' and got.sub == "subtype=0x02"


def test_all_64_bits(spark):
    got = one(spark, x=codec.little(F.unhex(F.lit("FF" * 8)), 0, 8), y=codec.parse("ORPHAN", F.unhex(F.lit("6D65746108" + "FF" * 8)), 0))
    assert int(got.x) == int(got.y) == (1 << 64) - 1


def test_range_ends(spark):
    top = (1 << 64) - 1
    ends = [(10, 0, top), (10, 5, 15), (top, 10, top)]
    for start, length, want in ends:
        assert int(one(spark, x=attributes.range_end(F.lit(str(start)).cast("decimal(20,0)"), F.lit(length))).x) == want


def test_subtract(spark):
    cases = [
        ((10, 90), (30, 20), [(10, 20), (50, 50)]), ((10, 0), (30, 20), [(10, 20), (50, 0)]), ((10, 0), (30, 0), [(10, 20)]),
        ((10, 20), (40, 10), [(10, 20)]), ((10, 20), (0, 40), []),
    ]
    for held, gone, want in cases:
        x = one(spark, x=intervals.subtract(*[F.lit(v).cast("long") for v in (*held, *gone)])).x
        assert [(p.start, p.length) for p in x] == want


def test_human_bytes(spark):
    got = one(spark, a=attributes.human_bytes(F.lit(1023)), b=attributes.human_bytes(F.lit(3 * 1024**3 + 1024**3 // 10)), c=attributes.human_bytes_ui(F.lit(0)), d=attributes.human_bytes(F.lit(1 << 50)))
    assert (got.a, got.b, got.c, got.d) == ("1023 B", "3.1 GiB", "0.0 B", "1024.0 TiB")


def test_crc32c():
    def plain(data):
        out = 0xFFFFFFFF
        for b in data:
            out ^= b
            for _ in range(8):
                out = out >> 1 ^ (0x82F63B78 if out & 1 else 0)
        return out ^ 0xFFFFFFFF

    draw = random.Random(4)
    values = [b"123456789", b"", bytes(40)] + [draw.randbytes(n) for n in (1, 3, 4, 5, 12, 13, 63, 64, 500, 4000)]
    assert crc32c(values).tolist() == [plain(v) for v in values]
    assert plain(values[0]) == 0xE3069283 and [int(crc32c([v])[0]) for v in values] == [plain(v) for v in values]
    assert crc32c([]).tolist() == []


def test_batches_cover_and_fit():
    draw = random.Random(5)
    for _ in range(300):
        n = draw.randint(1, 40)
        files, extents, inode, at = [], [], 0, 0
        for _ in range(n):
            step = draw.random()
            inode, at = (inode + 1, 0) if step < 0.2 else (inode, at + (1 if step < 0.8 else 2))
            files.append(inode)
            extents.append(at)
        size = [draw.randint(1, 30) for _ in range(n)]
        target, slack = draw.randint(20, 90), draw.randint(0, 40)
        ends = policy.cut_points(files, extents, size, target, slack)
        assert ends[-1] == n and all(a < b for a, b in zip(ends, ends[1:], strict=False))
        for a, b in zip([0, *ends], ends, strict=False):
            assert b == a + 1 or sum(size[a:b]) <= target


def test_batch_cuts():
    # two files; the first fits with part of the second, so the cut goes back to the break
    assert policy.cut_points([1, 1, 2, 2], [0, 1, 0, 1], [4, 4, 4, 4], 12, 4) == [2, 4]
    # no slack: the second file fits a batch of its own and is put off
    assert policy.cut_points([1, 1, 2, 2], [0, 1, 0, 1], [4, 4, 4, 4], 12, 0) == [2, 4]
    # one long file is cut where it is full
    assert policy.cut_points([1] * 4, [0, 1, 2, 3], [4] * 4, 8, 100) == [2, 4]


def test_read_ahead():
    window = 100
    got = policy.read_ahead_plan([5, 10, 15, 60, 0], [5, 5, 45, 6, 5], window)
    assert got == [(1, None, None), (2, 15, 115), (3, None, None), (4, 115, 166), (1, None, None)]


def test_streams():
    own = policy.StreamTracker(streams=2, low=10, high=40, stride=5, slack=8)
    got = [own.read(o, 4)[:2] for o in (0, 4, 8, 12, 6, 1000, 2000, 16)]
    assert got == [("start", 10), ("continue", 20), ("continue", 40), ("continue", 40), ("behind", 10), ("start", 10), ("start", 10), ("continue", 40)]


def test_frontier():
    own = policy.StreamTracker(low=10, high=40, stride=5, depth=2)
    # a window at once, then whole windows up to two past each read
    assert [own.read(o, 5)[2:] for o in (0, 5, 10)] == [((0, 10), None), (None, (10, 50)), (None, (50, 90))]
    assert [own.read(o, 5)[2:] for o in (15, 20)] == [(None, (90, 130)), (None, None)]
    # a read past the frontier fetches for itself
    assert own.read(500, 5) == ("start", 10, (500, 510), None)
    assert policy.StreamTracker().read(0, 1 << 20) == ("start", 128 << 10, (0, 1 << 20), None)


def test_fetched_ranges_cover_streams():
    draw = random.Random(2)
    for _ in range(100):
        own, fetched, at = policy.StreamTracker(low=8, high=64, stride=32), set(), 0
        for _ in range(60):
            at = draw.randrange(400) if draw.random() < 0.1 else at + draw.choice((0, 0, 0, 3))
            n = draw.randint(1, 12)
            effect, window, now, ahead = own.read(at, n)
            for span in (now, ahead):
                fetched.update(range(*(span or (0, 0))))
            assert window <= 64 and (not ahead or ahead[1] <= at + (own.depth + 1) * window)
            if effect == "behind":
                at += n
                continue
            assert set(range(at, at + n)) <= fetched
            at += n


def test_round_budgets():
    draw = random.Random(9)
    for _ in range(200):
        budget = draw.randint(10, 200)
        own = policy.Round(budget, slots=8, reserved_slots=4)
        for k in range(3):
            own.chain([((k, i), draw.randint(1, 40)) for i in range(2)], [(0, 1)], draw.random() < 0.8)
        own.candidates([((9, i), draw.randint(1, 40)) for i in range(10)], {(9, 1), (9, 7)})
        own.tail([((8, i), draw.randint(1, 40)) for i in range(5)])
        assert own.held_live <= own.reserve and own.held_slots <= 4 and len(own.taken) <= 8
        assert own.live < budget + 40


def test_round_prefers_pairs():
    own = policy.Round(20)
    own.chain([("a", 9), ("b", 9), ("c", 1)], [(0, 1), (0, 2), (1, 2)], True)
    assert list(own.taken) == ["a", "c"]
    own.chain([("d", 30)], [], True)
    assert own.unpackable == 1
    own.chain([("e", 1), ("f", 1)], [(0, 1)], True)
    assert own.deferred == 1
    own.chain([("g", 1)], [], False)
    assert own.warm == 1
