"""Scalar rules of the file system: attributes, sizes, ranges, permissions, renderings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENT_BYTES = 32768
U64_MAX = "18446744073709551615"
I64_MAX = (1 << 63) - 1


def attribute_size(kind: Column, size: Column, target_length: Column) -> Column:
    """Reported size: 4096 for directories, the target's length for links, 0 for special files."""
    return F.when(kind == "directory", 4096).when(kind == "file", size).when(kind == "symlink", target_length).otherwise(0).cast("long")


def file_type(kind: Column) -> Column:
    codes = {"file": 1, "directory": 2, "block_device": 3, "char_device": 4, "symlink": 5, "socket": 6, "fifo": 7}
    return reduce(lambda c, x: F.when(kind == x[0], x[1]).otherwise(c), codes.items(), F.lit(None).cast("int"))


def fallocate_bits(mode: Column) -> Column:
    """Linux mode bits of an allocation request."""
    # FALLOC_FL_* of linux/falloc.h.
    return F.when(mode == "allocate", 0).when(mode == "keep_size", 1).when(mode == "punch_hole", 3).when(mode == "zero_range", 16).when(mode == "zero_range_keep_size", 17)


def size_delta(old: Column, new: Column) -> Column:
    """new - old of unsigned sizes, clamped alike on both sides of zero."""
    d = new.cast("decimal(38,0)") - old.cast("decimal(38,0)")
    return F.greatest(F.least(d, F.lit(I64_MAX).cast("decimal(38,0)")), F.lit(-I64_MAX).cast("decimal(38,0)")).cast("long")


def shard_of(inode_id: Column, shards: int = 100) -> Column:
    return F.pmod(inode_id, F.lit(shards))



def live_permille(live: Column, total: Column) -> Column:
    return _div(live.cast("decimal(38,0)") * 1000, F.greatest(total, F.lit(1)))


def dead_percent(live: Column, total: Column) -> Column:
    dead = F.greatest(total - live, F.lit(0).cast("long"))
    return F.when(total > 0, _div(dead.cast("decimal(38,0)") * 100, total)).otherwise(0).cast("long")


def _div(a: Column, b: Column) -> Column:
    """Integer division of non-negative numbers without leaving decimals."""
    a, b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    return ((a - a % b) / b).cast("decimal(20,0)").cast("long")


def extent_count(size: Column, extent: int = EXTENT_BYTES) -> Column:
    return _div(size + (extent - 1), F.lit(extent))


def extent_range(offset: Column, length: Column, extent: int = EXTENT_BYTES) -> tuple[Column, Column]:
    """First and last extent of a byte range of at least one byte."""
    return _div(offset, F.lit(extent)), _div(offset + length - 1, F.lit(extent))


def human_bytes(n: Column, units: tuple[str, ...] = ("B", "KiB", "MiB", "GiB", "TiB"), whole_bytes: bool = True) -> Column:
    """A size with one decimal (ties to even) in the largest unit below 1024 of it."""
    out = None
    for k, unit in reversed(list(enumerate(units))):
        shown = n.cast("string") if k == 0 and whole_bytes else F.format_string("%.1f", F.bround(n.cast("double") / float(1024**k), 1))
        text = F.concat(shown, F.lit(f" {unit}"))
        out = text if out is None else F.when(n < F.lit(float(1024 ** (k + 1))), text).otherwise(out)
    return out


def human_bytes_ui(n: Column) -> Column:
    return human_bytes(n, ("B", "KB", "MB", "GB", "TB", "PB", "EB"), whole_bytes=False)


def mode_mask(mode: Column) -> Column:
    return mode.bitwiseAND(0o7777)


def filename_ok(name: Column, limit: int = 255) -> Column:
    return F.octet_length(name) <= limit


def range_end(start: Column, length: Column) -> Column:
    """Exclusive end of a lock range as decimal(20,0); length 0 reaches to the end of the file."""
    top = F.lit(U64_MAX).cast("decimal(20,0)")
    return F.when(length == 0, top).otherwise(F.least((start.cast("decimal(21,0)") + length.cast("decimal(21,0)")), top.cast("decimal(21,0)")).cast("decimal(20,0)"))


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def query_pattern(query: Column) -> Column:
    """A case-insensitive regular expression for a search box: /re/, a glob with * and ?, or plain text."""
    inner = F.regexp_extract(query, r"^/(.*)/[a-z]*$", 1)
    quoted = F.regexp_replace(query, r"([\\.^$|()\[\]{}+*?])", r"\\$1")
    globbed = F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit(r"\*"), F.lit(".*")), F.lit(r"\?"), F.lit(".")), F.lit("$"))
    return F.concat(F.lit("(?i)"), F.when(query.rlike(r"^/.+/[a-z]*$"), inner).when(query.rlike(r"[*?]"), globbed).otherwise(quoted))


def octal_mode(mode: Column) -> Column:
    return F.lpad(F.conv(mode.cast("string"), 10, 8), 4, "0")


def event_text(operation: Column, offset: Column, length: Column, mode: Column) -> Column:
    """Parameters of an access event as one line shows them."""
    span = F.concat(F.lit("offset="), offset.cast("string"), F.lit(" length="), length.cast("string"))
    return F.when(operation.isin("read", "write"), span).when(operation == "create", F.concat(F.lit("mode="), octal_mode(mode))).otherwise("")


def is_hole(data: Column) -> Column:
    """Whether an extent's bytes are all zero (it is then stored as no row)."""
    return F.length(F.replace(F.hex(data), F.lit("0"), F.lit(""))) == 0


def member(gid: Column, own: Column, own_known: Column, groups: Column, complete: Column) -> tuple[Column, Column]:
    """Known membership of a group, and possible membership (lists may be incomplete; 16 entries count)."""
    known = (own_known & (own == gid)) | F.array_contains(F.slice(groups, 1, 16), gid)
    return known, known | ~complete


def access(mode: Column, uid: Column, gid: Column, who: Column, known: Column, complete: Column, bit: int) -> Column:
    """Whether a user may read (4), write (2) or execute (1).

    Root needs an execute bit of any class to execute.  For others the first class that
    fits decides alone; a user whose groups are not all known gets group or other bits.
    """
    has = lambda bits: mode.bitwiseAND(bits) != 0
    root = has(0o111) if bit == 1 else F.lit(True)
    return F.when(who == 0, root).when(who == uid, has(bit << 6)).when(known, has(bit << 3)).when(~complete, has(bit << 3 | bit)).otherwise(has(bit))


def owns(who: Column, uid: Column) -> Column:
    return (who == 0) | (who == uid)


def may_delete(parent_is_dir: Column, parent_mode: Column, parent_uid: Column, target_uid: Column, who: Column) -> Column:
    """The sticky bit of a directory keeps others' files."""
    return ~(parent_is_dir & (parent_mode.bitwiseAND(0o1000) != 0) & (who != 0) & (who != parent_uid) & (who != target_uid))


def may_set_times(who: Column, uid: Column, to_now: Column, may_write: Column) -> Column:
    return F.when(owns(who, uid), True).when(to_now, may_write).otherwise(False)
