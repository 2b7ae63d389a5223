"""Segment objects as bytes: compressed frames, their directory, and a footer whose checksum covers the two.

Frames are compressed and not encrypted.  An object is built and read in one task; its size is bounded by the size
at which segments are sealed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.checksum import crc32c

# Mark, version and layout of the footer (mark, version, frames, offset and bytes of the directory, epoch,
# counter, sequence number, bytes of the object, checksum, reserved) and of a directory entry (offset, bytes, inode, extent).
MAGIC = b"ZSEG"
VERSION = 1
FOOTER = struct.Struct("<4sIIQIQQQQII")
ENTRY = struct.Struct("<QIQQ")
ZSTD = b"\x28\xb5\x2f\xfd"

#: What can be wrong with an object's tail, in the order in which it is looked at.
FAULTS = ("short", "magic", "version", "size", "reserved", "apart", "checksum", "segment", "directory")

FRAME = "epoch long, counter long, frame_index long, inode long, extent long, payload binary"


#: Bytes that a task gathers before it hands rows on; one object or frame may be larger.
GATHER = 16 << 20


class Fault(ValueError):
    """Why an object cannot be read: one of FAULTS, or ``frame``."""


compressor = cache(zstandard.ZstdCompressor)
decompressor = cache(zstandard.ZstdDecompressor)


def pack(data: bytes, codec: str = "zstd", level: int = 3) -> bytes:
    """Compressed bytes behind their plain length in four bytes."""
    body = compressor(level).compress(data) if codec == "zstd" else pa.compress(data, codec="lz4_raw", asbytes=True)
    return struct.pack("<I", len(data)) + body


def unpack(data: bytes) -> bytes:
    """What ``pack`` got; the codec is told by the mark of its frames."""
    if len(data) < 4:
        raise Fault("frame")
    size = int.from_bytes(data[:4], "little")
    try:
        if data[4:8] == ZSTD:
            out = decompressor().decompress(data[4:], max_output_size=size)
        else:
            out = pa.decompress(data[4:], decompressed_size=size, codec="lz4_raw", asbytes=True)
    except (zstandard.ZstdError, OSError, ValueError) as e:
        raise Fault("frame") from e
    if len(out) != size:
        raise Fault("frame")
    return out


def build(epoch: int, counter: int, frames: Iterable[tuple[int, int, bytes]], seqno: int = 0, codec: str = "zstd") -> bytes:
    """A segment object of (inode, extent, payload) in frame order."""
    out, entries = bytearray(), []
    for inode, extent, payload in frames:
        body = pack(payload, codec)
        entries.append(ENTRY.pack(len(out), len(body), inode, extent))
        out += struct.pack("<I", len(body)) + body
    directory = pack(b"".join(entries), codec)
    size = len(out) + len(directory) + FOOTER.size
    footer = FOOTER.pack(MAGIC, VERSION, len(entries), len(out), len(directory), epoch, counter, seqno, size, 0, 0)
    check = int(crc32c([directory + footer[:-8]])[0])
    return bytes(out) + directory + footer[:-8] + struct.pack("<II", check, 0)


def directory(data: bytes, epoch: int | None = None, counter: int | None = None, size: int | None = None) -> list[tuple[int, int, int, int]]:
    """The entries of an object, or a Fault.  ``data`` may be the end of an object of ``size`` bytes, from its directory on or earlier."""
    size = len(data) if size is None else size
    if len(data) < FOOTER.size:
        raise Fault("short")
    magic, version, k, offset, length, own_epoch, own_counter, _, total, check, reserved = FOOTER.unpack(data[-FOOTER.size :])
    tail = length + FOOTER.size
    faults = [
        ("magic", magic != MAGIC),
        ("version", version != VERSION),
        ("size", total != size),
        ("reserved", reserved != 0),
        ("apart", offset + tail != total),
        ("short", tail > len(data)),
    ]
    for name, found in faults:
        if found:
            raise Fault(name)
    if int(crc32c([data[len(data) - tail : len(data) - 8]])[0]) != check:
        raise Fault("checksum")
    if epoch is not None and (epoch, counter) != (own_epoch, own_counter):
        raise Fault("segment")
    try:
        plain = unpack(data[len(data) - tail : len(data) - FOOTER.size])
    except Fault as e:
        raise Fault("directory") from e
    if len(plain) != k * ENTRY.size:
        raise Fault("directory")
    return list(ENTRY.iter_unpack(plain))


def payload(data: bytes, entry: tuple[int, int, int, int]) -> bytes:
    """A frame's payload, read by its directory entry."""
    at, length = entry[:2]
    if int.from_bytes(data[at : at + 4], "little") != length or at + 4 + length > len(data):
        raise Fault("frame")
    return unpack(data[at + 4 : at + 4 + length])


def gathered(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows, whose last value is bytes or None, in frames of some GATHER bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"") + 64
        if size >= GATHER:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def seal(frames: DataFrame, codec: str = "zstd") -> DataFrame:
    """(epoch, counter, object) of frames with ``inode``, ``extent`` and ``payload`` (null: empty) in order of ``frame_index``.

    A task goes through its segments in order and holds the frames of one.
    """

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for rows in batches:
            yield from rows.itertuples(index=False, name=None)

    def sealed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segments = groupby(rows_of(batches), key=lambda r: r[:2])
        built = ((*key, build(*key, ((r[3], r[4], r[5] or b"") for r in own), codec=codec)) for key, own in segments)
        return gathered(built, ["epoch", "counter", "object"])

    rows = frames.select("epoch", "counter", "frame_index", "inode", "extent", "payload")
    rows = rows.repartition("epoch", "counter").sortWithinPartitions("epoch", "counter", "frame_index")
    return rows.mapInPandas(sealed, "epoch long, counter long, object binary")


def status(objects: DataFrame) -> DataFrame:
    """epoch, counter, ``status`` (``whole`` or one of FAULTS) and number of frames (null with a fault) of each object."""

    def looked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for epoch, counter, data in zip(rows["epoch"], rows["counter"], rows["object"], strict=True):
                try:
                    out.append((epoch, counter, "whole", len(directory(data or b"", epoch, counter))))
                except Fault as e:
                    out.append((epoch, counter, str(e), None))
            yield pd.DataFrame(out, columns=["epoch", "counter", "status", "frames"]).astype({"frames": "Int64"})

    return objects.select("epoch", "counter", "object").mapInPandas(looked, "epoch long, counter long, status string, frames long")


def read_frames(objects: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """The frames ``first`` to ``last`` of each object with their payloads; objects with a fault give none, frames with one a null payload."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for rows in batches:
            for epoch, counter, data in zip(rows["epoch"], rows["counter"], rows["object"], strict=True):
                try:
                    entries = directory(data or b"", epoch, counter)
                except Fault:
                    continue
                for k, entry in list(enumerate(entries))[first : None if last is None else last + 1]:
                    try:
                        plain = payload(data, entry)
                    except Fault:
                        plain = None
                    yield epoch, counter, k, entry[2], entry[3], plain

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return gathered(found(batches), ["epoch", "counter", "frame_index", "inode", "extent", "payload"])

    return objects.select("epoch", "counter", "object").mapInPandas(read, FRAME)


def damaged(objects: DataFrame) -> DataFrame:
    """Objects with the last byte of their directory turned over."""
    at = f"length(object) - {FOOTER.size}"
    other = f"unhex(lpad(hex(255 - cast(conv(hex(substring(object, {at}, 1)), 16, 10) as int)), 2, '0'))"
    return objects.withColumn("object", F.expr(f"overlay(object placing {other} from {at})"))
