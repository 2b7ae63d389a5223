"""Keys and values of the metadata store as column expressions.

A key is a domain ("meta" or "extent"), one kind byte, and big-endian 64-bit ids;
values are little-endian.  Parsers give NULL where domain, kind or length do not fit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kind bytes and domains of the key space.
KINDS = {"INODE": 0x01, "DIR_ENTRY": 0x02, "DIR_SCAN": 0x03, "DIR_COOKIE": 0x04, "STATS": 0x05, "SYSTEM": 0x06, "TOMBSTONE": 0x07, "ORPHAN": 0x08, "SEGCOUNT": 0x09, "EXTENT": 0xFE}
META, EXTENT = "6D657461", "657874656E74"
#: Number of 64-bit ids of each kind; DIR_ENTRY has a name after its id, SYSTEM a subtype byte.
IDS = {"INODE": 1, "DIR_ENTRY": 1, "DIR_SCAN": 2, "DIR_COOKIE": 1, "STATS": 1, "SYSTEM": 0, "TOMBSTONE": 2, "ORPHAN": 1, "SEGCOUNT": 2, "EXTENT": 2}
NAMES = {
    "INODE": ["inode_id"], "DIR_ENTRY": ["dir_id"], "DIR_SCAN": ["dir_id", "cookie"], "DIR_COOKIE": ["dir_id"], "STATS": ["shard_id"], "TOMBSTONE": ["timestamp", "inode_id"],
    "ORPHAN": ["inode_id"], "SEGCOUNT": ["epoch", "counter"], "EXTENT": ["inode_id", "extent_index"],
}


def be64(value: Column) -> Column:
    """Hex of a 64-bit number, most significant byte first."""
    return F.lpad(F.hex(value.cast("long")), 16, "0")


def le64(value: Column) -> Column:
    """Hex of a 64-bit number, least significant byte first."""
    return _swapped(be64(value))


def le32(value: Column) -> Column:
    return F.substring(le64(value), 1, 8)


def _swapped(text: Column, size: int = 8) -> Column:
    return F.concat(*[F.substring(text, 2 * k + 1, 2) for k in reversed(range(size))])


def _prefix(kind: str) -> str:
    return (EXTENT if kind == "EXTENT" else META) + f"{KINDS[kind]:02X}"


def key(kind: str, *ids: Column, name: Column | None = None) -> Column:
    """The binary key of a kind; name: raw bytes of a directory entry's name."""
    parts = [F.lit(_prefix(kind)), *(be64(x) for x in ids)]
    if name is not None:
        parts.append(F.hex(name.cast("binary")))
    return F.unhex(F.concat(*parts))


def system_key(subtype: int) -> Column:
    return F.unhex(F.lit(f"{_prefix('SYSTEM')}{subtype:02X}"))


def number(text: Column) -> Column:
    """A big-endian hex number as decimal(20,0), so all 64 bits fit."""
    return F.conv(text, 16, 10).cast("decimal(20,0)")


def _id(text: Column, kind: str, k: int) -> Column:
    return number(F.substring(text, len(_prefix(kind)) + 1 + 16 * k, 16))


def parse(kind: str, value: Column, k: int) -> Column:
    """The k-th id of a key of exactly this kind and length, else NULL."""
    text = F.hex(value)
    size = len(_prefix(kind)) + 16 * IDS[kind]
    return F.when(F.startswith(text, F.lit(_prefix(kind))) & (F.length(text) == size), _id(text, kind, k))


def kind_of(value: Column) -> Column:
    """Name of a key's kind; NULL for unknown domains or bytes, and for kinds in the wrong domain."""
    text = F.hex(value)
    found = F.lit(None).cast("string")
    for name in KINDS:
        found = F.when(F.startswith(text, F.lit(_prefix(name))), name).otherwise(found)
    return found


def describe(value: Column) -> Column:
    """Readable ids of a key; ``raw=`` and hex where the rest is malformed; NULL for no key."""
    text, kind = F.hex(value), kind_of(value)
    detail = F.concat(F.lit("raw="), text)
    for name, ids in NAMES.items():
        size = len(_prefix(name)) + 16 * IDS[name]
        parts = F.concat_ws(", ", *[F.concat(F.lit(f"{i}="), _id(text, name, k).cast("string")) for k, i in enumerate(ids)])
        if name == "DIR_ENTRY":
            shown = F.concat(parts, F.lit(', name="'), F.decode(F.unhex(F.substring(text, size + 1, 1 << 20)), "UTF-8"), F.lit('"'))
            detail = F.when((kind == name) & (F.length(text) > size), shown).otherwise(detail)
        else:
            detail = F.when((kind == name) & (F.length(text) == size), parts).otherwise(detail)
    sub = F.concat(F.lit("subtype=0x"), F.lower(F.coalesce(F.nullif(F.substring(text, len(META) + 3, 2), F.lit("")), F.lit("00"))))
    return F.when(kind.isNull(), F.lit(None).cast("string")).when(kind == "SYSTEM", sub).otherwise(detail)


def frame_loc(epoch: Column, counter: Column, frame_index: Column, byte_offset: Column, byte_len: Column) -> Column:
    """The 32-byte location of a frame."""
    return F.unhex(F.concat(le64(epoch), le64(counter), le32(frame_index), le64(byte_offset), le32(byte_len)))


def little(value: Column, at: int, size: int) -> Column:
    """A little-endian number of ``size`` bytes at byte ``at`` of a value."""
    return F.conv(_swapped(F.substring(F.hex(value), 2 * at + 1, 2 * size), size), 16, 10).cast("decimal(20,0)")


def frame_loc_fields(value: Column) -> dict[str, Column]:
    layout = {"epoch": (0, 8), "counter": (8, 8), "frame_index": (16, 4), "byte_offset": (20, 8), "byte_len": (28, 4)}
    return {k: F.when(F.octet_length(value) == 32, little(value, at, n)) for k, (at, n) in layout.items()}


def segcount_value(live: Column, total: Column) -> Column:
    return F.unhex(F.concat(le64(live), le64(total)))


def segcount_fields(value: Column) -> dict[str, Column]:
    """live and total; the 8-byte form of old has live only, and total is equal to it."""
    n = F.octet_length(value)
    live = F.when(n.isin(8, 16), little(value, 0, 8))
    return {"live": live, "total": F.when(n == 16, little(value, 8, 8)).when(n == 8, live)}


def stamp_fields(value: Column) -> dict[str, Column]:
    """Epoch, sequence number and (in later versions) lineage of a leadership stamp of 16, 24 or 40 bytes."""
    n = F.octet_length(value)
    known = n.isin(16, 24, 40)
    return {
        "version": F.when(n == 16, 1).when(n == 24, 2).when(n == 40, 3),
        "epoch": F.when(known, little(value, 0, 8)),
        "seqno": F.when(known, little(value, 8, 8)),
        "extra": F.when(n >= 24, F.when(known, little(value, 16, 8))),
        "lineage": F.when(n == 40, F.hex(F.substring(value, 25, 16))),
    }


def entry_fields(value: Column) -> dict[str, Column]:
    """inode id and cookie of a directory entry's value."""
    whole = F.octet_length(value) == 16
    return {"inode_id": F.when(whole, little(value, 0, 8)), "cookie": F.when(whole, little(value, 8, 8))}


def scan_value(name: Column, inode_id: Column) -> Column:
    """A listing row's value: length of the name, name, inode id."""
    return F.unhex(F.concat(le32(F.octet_length(name)), F.hex(name.cast("binary")), le64(inode_id)))


def scan_fields(value: Column) -> dict[str, Column]:
    text = F.hex(value)
    n = little(value, 0, 4).cast("int")
    whole = (F.octet_length(value) >= 12) & (F.octet_length(value) == n + 12)
    tail = F.unhex(F.substring(text, F.length(text) - 15, F.lit(16)))
    return {"name": F.when(whole, F.decode(F.unhex(F.substring(text, F.lit(9), n * 2)), "UTF-8")), "inode_id": F.when(whole, little(tail, 0, 8))}


def object_key(epoch: Column, counter: Column) -> Column:
    """Path of a segment object; objects are spread by the counter's lowest byte."""
    hex16 = lambda x: F.lower(be64(x))
    return F.concat(F.lit("segments/"), F.lower(F.lpad(F.hex(counter.bitwiseAND(255)), 2, "0")), F.lit("/"), hex16(epoch), F.lit("/"), hex16(counter))


def object_key_fields(path: Column) -> dict[str, Column]:
    """epoch and counter of a path that object_key makes, else NULL."""
    shape = r"^segments/([0-9a-f]{2})/([0-9a-f]{16})/([0-9a-f]{14}([0-9a-f]{2}))$"
    part = lambda k: F.regexp_extract(path, shape, k)
    good = path.rlike(shape) & (part(1) == part(4))
    return {"epoch": F.when(good, number(part(2))), "counter": F.when(good, number(part(3)))}
