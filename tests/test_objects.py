"""Segment objects: round trips, every fault of a tail, damaged frames; seams of single reads."""

import random
import struct

import pytest

from tidemark.operators import layout
from tidemark.sources import objects

FRAMES = [(7, 0, b"a" * 5000), (7, 1, b""), (9, 4, bytes(range(256)))]


def fault(data, **more):
    with pytest.raises(objects.Fault) as e:
        objects.directory(data, 3, 12, **more)
    return str(e.value)


def changed(data, at, new):
    at = len(data) + at if at < 0 else at
    return data[:at] + new + data[at + len(new) :]


@pytest.mark.parametrize("codec", ["zstd", "lz4"])
def test_round_trip(codec):
    data = objects.build(3, 12, FRAMES, codec=codec)
    entries = objects.directory(data, 3, 12)
    assert [(e[2], e[3], objects.payload(data, e)) for e in entries] == FRAMES
    # a ranged read of the tail is enough for the directory
    start = entries[-1][0] + 4 + entries[-1][1]
    assert objects.directory(data[start:], 3, 12, size=len(data)) == entries
    assert objects.directory(objects.build(3, 12, []), 3, 12) == []


def test_every_fault():
    data = objects.build(3, 12, FRAMES)
    found = {
        fault(data[-63:]), fault(changed(data, -64, b"X")), fault(changed(data, -60, b"\2")), fault(data[1:]), fault(changed(data, -1, b"\1")),
        fault(changed(data, -52, b"\1")), fault(changed(data, -65, bytes([data[-65] ^ 1]))),
    }
    assert found == {"short", "magic", "version", "size", "reserved", "apart", "checksum"}
    assert fault(data[-64:], size=len(data)) == "short"
    assert fault(objects.build(3, 13, FRAMES)) == "segment"
    one_more = changed(data, -56, struct.pack("<I", 4))
    check = int(objects.crc32c([one_more[struct.unpack("<Q", data[-52:-44])[0] : -8]])[0])
    assert fault(changed(one_more, -8, struct.pack("<I", check))) == "directory"


def test_objects_of_tables(spark):
    draw = random.Random(1)
    rows = [(1, s, k, 100 + k, k * 2, draw.randbytes(draw.randint(0, 900)) if k % 4 else None) for s in range(5) for k in range(s + 1)]
    draw.shuffle(rows)
    sealed = objects.seal(spark.createDataFrame(rows, objects.FRAME))
    got = {tuple(r) for r in objects.read_frames(sealed).collect()}
    assert got == {(*r[:5], r[5] or b"") for r in rows}
    assert {r["frame_index"] for r in objects.read_frames(sealed, 1, 2).collect()} == {1, 2}
    assert sorted((r["counter"], r["status"], r["frames"]) for r in objects.status(sealed).collect()) == [(s, "whole", s + 1) for s in range(5)]
    broken = objects.damaged(sealed)
    assert {(r["status"], r["frames"]) for r in objects.status(broken).collect()} == {("checksum", None)}
    assert objects.read_frames(broken).count() == 0
    first = spark.createDataFrame([(1, 1, bytearray(changed(objects.build(1, 1, FRAMES), 0, b"\xff"))), (1, 2, None)], "epoch long, counter long, object binary")
    assert [r["payload"] is None for r in objects.read_frames(first).orderBy("frame_index").collect()] == [True, False, False]
    assert {r["status"] for r in objects.status(first).collect()} == {"whole", "short"}


def test_seams_of_reads(spark):
    schema = "event_id long, inode long, extent long, epoch long, counter long, frame_index long, byte_offset long, byte_len long"
    rows = [
        (1, 5, 0, 1, 9, 0, 0, 10), (1, 5, 1, 1, 9, 1, 10, 10),  # one run
        (1, 5, 2, 1, 4, 0, 0, 10),  # a seam
        (1, 5, 4, 1, 9, 7, 70, 10),  # behind a hole
        (1, 5, 5, 1, 9, 9, 90, 10),  # scattered in one segment
        (1, 5, 6, 1, 4, 3, 30, 10), (1, 5, 7, 1, 9, 2, 20, 10),  # the first pair again, twice
        (2, 6, 0, 1, 1, 0, 0, 10),
    ]
    touched = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in layout.read_seams(touched).orderBy("extent").collect()]
    assert got == [(1, 1, 4, 1, 9, 2), (1, 1, 9, 1, 9, 5)]
    assert layout.read_seams(touched, most=1).count() == 1 and layout.read_seams(touched.where("false")).count() == 0
    many = spark.createDataFrame([(3, 1, k, 1, k, 0, 0, 10) for k in range(40)], schema)
    assert sorted(r["extent"] for r in layout.read_seams(many).collect()) == list(range(1, 17))
    assert sorted(r["counter"] for r in layout.nominations(many).collect()) == list(range(16))
