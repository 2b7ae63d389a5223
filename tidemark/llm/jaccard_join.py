"""Near-duplicate documents by exact Jaccard similarity of word shingles.

Documents with equal shingle sets form a class.  Classes whose sets reach the
similarity differ in at most D = (|x| + |y|) / 7 shingles.  The shingle universe is cut
into segments, more than D of them for every size band; a set emits a key
(band, segment, hash of its shingles there) for its first D + 1 + e non-empty
segments.  By the pigeonhole principle two similar sets share 1 + e keys at least.

Cost-based allocation: a key that more than ``max_group`` classes share is hot and
pairs nobody.  A similar pair can then be lost only if each of its sets has 1 + e hot
keys; such sets are called hard, and only hard sets are compared through hot
keys: first each with a hub of about its size, then, once the components of all verified links are
known, with the sets of other components that odd sketches do not rule out (the
differing bits of two sketches are a lower bound of differing shingles; a hot key of many members is
dealt out in pairs of blocks of them).  Sets too
crowded for the guarantee, and small ones, use single shingles as segments.  Hot keys
are recognised within each task already, which forwards one entry of them, and all
pairs that are left are verified exactly.

That gives the exact components, but not every link in them.  Links join members of one
component only, so they are counted by comparing all sets of a component exactly, in pairs
of bounded blocks that meet in one task.

Sets are named by 64 bits, checked by 64 more: where different sets share a name, all are named anew.

Results for odd input: null, empty and blank texts have 0 shingles and are their own
component; texts of fewer than five words are one shingle; rows with a null doc_id
get a null component and take no part; equal doc_ids share a component only if
linked; an empty table gives an empty result; extra columns are ignored.  A document with
shingles is linked with every other row of an equal set; a null doc_id has a null count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.llm._graph import components
from tidemark.llm._spark import partitions, saved, small, table

SHINGLE_WORDS = 5
#: Classes of one key that are paired with each other.
MAX_GROUP = 8
#: Keys beyond the guarantee, in percent of it, so that hot keys can be passed over.
EXTRA_PERCENT = 15
#: Sets up to this size use single shingles as segments.
SINGLES = 31
#: Keys that a task gathers before it deals them out.
FLUSH = 1 << 18
#: Times that hard sets are joined by spanning pairs before all that is left is looked at.
SPANNING_ROUNDS = 2
#: Text that is hashed at once.
CHUNK_BYTES = 1 << 18
#: Keys of hard sets that a task deals out at once, each with a sketch of no more than this band's size.
KEYS_AT_ONCE, SHORT_BAND = 50_000, 8
#: Sets of a component, and shingles of them, that a block is meant to hold; shingles whose overlaps are counted at once.
BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 256, 500_000, 4096

#: Members of a hot key that are compared by one task; larger groups are dealt out in pairs of blocks.
MEMBERS = 2048
#: Times that classes are named anew where two different sets share a 64-bit name.
SALTS = 8

ENTRY = np.dtype([("key", "<u8"), ("sig", "<i8"), ("n", "<i4"), ("need", "<u2"), ("way", "u1"), ("hot", "u1")])
NEVER = 65535
_SETS = np.dtype([(k, ENTRY[k]) for k in ("sig", "n", "need", "way", "hot")])
PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])
LIGHT = np.dtype([("doc_id", "<i8"), ("n", "<i8"), ("sig", "<i8"), ("check", "<i8"), ("known", "u1"), ("row", "<i8")])


def shingle_sets(texts: list[bytes]):
    """For each chunk: rows, set sizes, shingle hashes (sorted, distinct) and their document."""
    for chunk in _text.chunks(texts, lower=True, limit=CHUNK_BYTES):
        found = [chunk.windows(SHINGLE_WORDS)]
        for width in range(1, SHINGLE_WORDS):
            if (chunk.counts == width).any():
                h, at, doc = chunk.windows(width)
                own = chunk.counts[doc] == width
                found.append((_text.mix(h[own] + np.uint64(width)), at[own], doc[own]))
        h, doc = np.concatenate([x[0] for x in found]), np.concatenate([x[2] for x in found])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        yield np.asarray(chunk.rows), np.bincount(doc, minlength=len(chunk.rows)), h, doc


def _class_ids(h: np.ndarray, doc: np.ndarray, n: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names for each distinct set; 0 for the empty set."""
    out = []
    full = np.flatnonzero(n)
    for key in (2 * salt, 2 * salt + 1):
        name = np.zeros(len(n), dtype=np.uint64)
        if len(full):
            seed = _text.mix(np.array([0x5851F42D4C957F2D + key], dtype=np.uint64))[0]
            sums = np.add.reduceat(_text.mix(h ^ seed), np.searchsorted(doc, full))
            name[full] = _text.mix(sums + n[full].astype(np.uint64))
        out.append(name.view(np.int64))
    return tuple(out)


def _prefix(first: np.ndarray, doc: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Of segments (ordered by document): those among the first ``limit`` of their document."""
    owner = doc[first]
    begin = np.searchsorted(owner, np.arange(len(limit)))
    return np.arange(len(first)) - begin[owner] < limit[owner]


def _keys(h: np.ndarray, doc: np.ndarray, n: np.ndarray, sig: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The entries of all sets of a chunk: in the band of their size, and in the next one if a partner can be there."""
    out = []
    band0 = np.zeros(len(n), dtype=np.int64)
    band0[n > 0] = np.floor(np.log2(n[n > 0] + 0.5)).astype(np.int64)
    most = n * 4 // 3
    for step in (0, 1):
        band = band0 + step
        top = (1 << (band + 1)) - 1
        use = known & (n > 0) & ((step == 0) | (most >= 1 << band))
        d = (n + np.minimum(most, top)) // 7
        extra = -(-(d + 1) * EXTRA_PERCENT // 100)
        limit = d + 1 + extra
        segments = (3 * (2 * top // 7 + 1) + 1) // 2
        single = use & (top <= SINGLES)
        for alone in (False, True):
            docs = single if alone else use & ~single
            own = docs[doc]
            hh, dd = h[own], doc[own]
            if not len(hh):
                continue
            if alone:
                first = np.arange(len(hh))
                segment, sums = np.zeros(len(hh), dtype=np.uint64), hh
            else:
                part = ((hh >> np.uint64(32)) * segments[dd].astype(np.uint64)) >> np.uint64(32)
                new = np.ones(len(hh), dtype=bool)
                new[1:] = (dd[1:] != dd[:-1]) | (part[1:] != part[:-1])
                first = np.flatnonzero(new)
                segment, sums = part[first], np.add.reduceat(_text.mix(hh ^ np.uint64(0x14057B7EF767814F)), first)
                crowded = docs & (np.bincount(dd[first], minlength=len(n)) <= d)
                single |= crowded
            owner = dd[first]
            way = band * 2 + alone
            place = segment + (way[owner].astype(np.uint64) << np.uint64(32))
            e = np.zeros(len(first), dtype=ENTRY)
            e["key"] = _text.mix(sums + _text.mix(place + np.uint64(0x2545F4914F6CDD1D)))
            e["sig"], e["n"], e["way"] = sig[owner], n[owner], way[owner]
            have = np.minimum(np.bincount(owner, minlength=len(n)), limit)
            e["need"] = np.where(have > d, np.minimum(have - d, NEVER - 1), NEVER)[owner]
            out.append(e[_prefix(first, dd, limit)])
    return np.concatenate(out) if out else np.zeros(0, dtype=ENTRY)


def _hubs(e: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Index of the hub of every entry of hot groups (sorted by group, n, sig): the first one of about its size."""
    step = np.floor(np.log(e["n"]) / np.log(1.12)).astype(np.int64)
    new = np.ones(len(e), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (step[1:] != step[:-1])
    first = np.flatnonzero(new)
    return first[np.cumsum(new) - 1]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), dtype=PAIR)
    out["a"], out["b"] = np.minimum(a, b), np.maximum(a, b)
    return _once(out[out["a"] != out["b"]])


def _once(p: np.ndarray) -> np.ndarray:
    p = p[np.lexsort((p["b"], p["a"]))]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p["a"][1:] != p["a"][:-1]) | (p["b"][1:] != p["b"][:-1])
    return p[new]


def _close(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= 75 * np.maximum(n, m)


def _grouped(e: np.ndarray, max_group: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries by key, each class once for a key: those of cold keys, those of hot ones."""
    e = e[np.lexsort((e["sig"], e["n"], e["key"]))]
    again = np.zeros(len(e), dtype=bool)
    again[1:] = (e["key"][1:] == e["key"][:-1]) & (e["sig"][1:] == e["sig"][:-1])
    if again.any():
        marks = np.flatnonzero(~again)
        hot = np.maximum.reduceat(e["hot"], marks)
        e = e[marks]
        e["hot"] = hot
    if not len(e):
        return e, e
    first = np.flatnonzero(np.concatenate(([True], e["key"][1:] != e["key"][:-1])))
    size = np.diff(np.append(first, len(e)))
    big = np.repeat((size > max_group) | (np.maximum.reduceat(e["hot"], first) > 0), size)
    return e[~big], e[big]


def _all_pairs(e: np.ndarray) -> np.ndarray:
    """Pairs of close sizes within the (small) groups of entries sorted by key."""
    out = []
    gap = 1
    while (same := e["key"][gap:] == e["key"][:-gap]).any():
        same &= _close(e["n"][gap:], e["n"][:-gap])
        out.append(_pairs(e["sig"][gap:][same], e["sig"][:-gap][same]))
        gap += 1
    return _once(np.concatenate(out)) if out else np.zeros(0, dtype=PAIR)


def _dealt(kind: int, rows: np.ndarray, by: np.ndarray, n: int) -> pa.RecordBatch:
    """Rows of a structured array as one blob for each of n buckets."""
    bucket = (by % np.uint64(n)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(by)), dtype=bool), np.diff(bucket[order]) != 0)))
    blob = _text.binary(rows[order], np.append(first, len(rows)))
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][first]), pa.array(np.full(len(first), kind, dtype=np.int32)), blob], ["bucket", "kind", "blob"])


def _compact(kind: int, e: np.ndarray, n: int):
    """Entries with what they share per set in a table of its own, one row for each bucket."""
    name = _text.mix(e["sig"].view(np.uint64) + (e["way"].astype(np.uint64) * np.uint64(2) + e["hot"]))
    _, some, which = np.unique(name, return_index=True, return_inverse=True)
    sets = np.empty(len(some), dtype=_SETS)
    for field in _SETS.names:
        sets[field] = e[field][some]
    bucket = (e["key"] % np.uint64(n)).astype(np.int32)
    order = np.lexsort((which, bucket))
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(e)), dtype=bool), np.diff(bucket[order]) != 0)))
    blobs = []
    for a, b in zip(first, np.append(first[1:], len(e)), strict=True):
        own = which[order[a:b]]
        have, local = np.unique(own, return_inverse=True)
        blobs.append(len(have).to_bytes(4, "little") + sets[have].tobytes() + local.astype(np.uint32).tobytes() + e["key"][order[a:b]].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][first]), pa.array(np.full(len(first), kind, dtype=np.int32)), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])


def _expand(blob: bytes, part: int) -> np.ndarray:
    """The entries of a compact blob whose keys belong to one of PARTS parts."""
    k = int.from_bytes(blob[:4], "little")
    at = 4 + k * _SETS.itemsize
    n = (len(blob) - at) // 12
    keys = np.frombuffer(blob, dtype=np.uint64, offset=at + 4 * n)
    take = np.flatnonzero(keys >> np.uint64(62) == part)
    own = np.frombuffer(blob[4:at], dtype=_SETS)[np.frombuffer(blob, dtype=np.uint32, count=n, offset=at)[take]]
    e = np.empty(len(take), dtype=ENTRY)
    for name in _SETS.names:
        e[name] = own[name]
    e["key"] = keys[take]
    return e


_BLOBS = "bucket int, kind int, blob binary"
_KEYS, _STARS, _HOT, _LIGHT = 0, 1, 2, 3
#: Pairs of blocks of members, by way.
_UNIT = 1000
PARTS = 4


def _candidates(docs: DataFrame, n_parts: int, max_group: int, salt: int) -> DataFrame:
    """Saved rows (bucket, kind, blob): pairs to verify, the entries of hot keys, and every document's class."""

    def emit(batches):
        waiting: list[np.ndarray] = []

        def flush():
            e = np.concatenate(waiting)
            waiting.clear()
            cold, hot = _grouped(e, max_group)
            heads = hot[np.concatenate((np.ones(min(1, len(hot)), dtype=bool), hot["key"][1:] != hot["key"][:-1]))].copy()
            heads["hot"] = 1
            keys = np.concatenate((cold, heads))
            if len(keys):
                yield _compact(_KEYS, keys, n_parts)
            if len(hot):
                yield _dealt(_HOT, hot, _text.mix(hot["sig"].view(np.uint64)), n_parts)

        for number, batch in enumerate(_text.sliced(batches)):
            ids = batch.column("doc_id")
            light = np.zeros(batch.num_rows, dtype=LIGHT)
            light["doc_id"], light["known"] = ids.fill_null(0).to_numpy(), np.asarray(ids.is_valid())
            if "row" in batch.schema.names:
                light["row"] = batch.column("row").to_numpy()
            for rows, n, h, doc in shingle_sets(_text.utf8(batch.column("text"))):
                sig, check = _class_ids(h, doc, n, salt)
                light["n"][rows], light["sig"][rows], light["check"][rows] = n, sig, check
                known = light["known"][rows] > 0
                waiting.append(_keys(h, doc, n, sig, known))
                if sum(map(len, waiting)) >= FLUSH:
                    yield from flush()
            yield pa.RecordBatch.from_arrays([pa.array([number % n_parts], pa.int32()), pa.array([_LIGHT], pa.int32()), pa.array([light.tobytes()])], ["bucket", "kind", "blob"])
        if waiting:
            yield from flush()

    def meet(batches):
        compact = []
        for batch in _text.sliced(batches):
            keys = np.asarray(batch.column("kind")) == _KEYS
            compact += batch.column("blob").filter(pa.array(keys)).to_pylist()
            yield batch.filter(pa.array(~keys))
        for part in range(PARTS if compact else 0):
            cold, hot = _grouped(np.concatenate([_expand(blob, part) for blob in compact]), max_group)
            pairs = _all_pairs(cold)
            if len(pairs):
                yield _dealt_pairs(pairs, n_parts)
            if len(hot):
                yield _dealt(_HOT, hot, _text.mix(hot["sig"].view(np.uint64)), n_parts)

    return saved(docs.mapInArrow(emit, _BLOBS).repartition(n_parts, "bucket").mapInArrow(meet, _BLOBS))


def _documents(found: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, sig, check, row) of every document."""

    def rows(batches):
        for batch in _text.sliced(batches):
            for blob in batch.column(0).to_pylist():
                x = np.frombuffer(blob, dtype=LIGHT)
                yield pa.RecordBatch.from_arrays([pa.array(x["doc_id"].copy(), mask=x["known"] == 0), pa.array(x["n"].copy()), *(pa.array(x[k].copy()) for k in ("sig", "check", "row"))], ["doc_id", "n_shingles", "sig", "check", "row"])

    return found.where(F.col("kind") == _LIGHT).select("blob").mapInArrow(rows, "doc_id long, n_shingles long, sig long, check long, row long")


def _dealt_pairs(p: np.ndarray, n_parts: int) -> pa.RecordBatch:
    return _dealt(_STARS, p, _text.mix(p["a"].view(np.uint64) ^ _text.mix(p["b"].view(np.uint64))), n_parts)


def _distinct_pairs(dealt: DataFrame, n_parts: int) -> DataFrame:
    """(a, b) rows, each once, from dealt blobs."""

    def once(batches):
        got = [np.frombuffer(b"".join(batch.column("blob").to_pylist()), dtype=PAIR) for batch in _text.sliced(batches)]
        if got:
            p = _once(np.concatenate(got))
            for k in range(0, len(p), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(p["a"][k : k + 10_000].copy()), pa.array(p["b"][k : k + 10_000].copy())], ["a", "b"])

    return dealt.repartition(n_parts, "bucket").mapInArrow(once, "a long, b long")


def _sets_of(texts: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.empty(0, dtype=np.uint64)] * len(texts)
    for rows, n, h, _ in shingle_sets(texts):
        for row, part in zip(rows.tolist(), np.split(h, np.cumsum(n)[:-1]), strict=True):
            out[row] = part
    return out


def _class_texts(docs: DataFrame, classes: DataFrame, sigs: DataFrame, salt: int) -> DataFrame:
    """(sig, n, odd, packed): size, odd sketch and compressed text of each class, from its first document."""
    need = saved(classes.join(sigs, "sig", "left_semi").select("sig", F.col("least").alias("doc_id")))

    def packed(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in _text.sliced(batches):
            texts = _text.utf8(batch.column("text"))
            sig, size = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            odd = [b""] * len(texts)
            for rows, n, h, doc in shingle_sets(texts):
                sig[rows], size[rows] = _class_ids(h, doc, n, salt)[0], n
                for row, own in zip(rows.tolist(), np.split(h, np.cumsum(n)[:-1]), strict=True):
                    odd[row] = _parity([own], len(own).bit_length() - 1).tobytes() if len(own) else b""
            right = pa.array(sig == batch.column("sig").to_numpy())  # others have the same doc_id
            columns = [batch.column("sig"), pa.array(size), pa.array(odd, pa.binary()), pa.array([squeeze.compress(t) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["sig", "n", "odd", "packed"]).filter(right)

    texts = docs.join(small(need), "doc_id").select("sig", "text").mapInArrow(packed, "sig long, n long, odd binary, packed binary")
    return saved(texts.dropDuplicates(["sig"]))


def _plausible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that sizes and odd sketches do not rule out."""
    left, right = (texts.select(F.col("sig").alias(k), F.col("n").alias(f"{k}_n"), F.col("odd").alias(f"{k}_odd")) for k in "ab")

    def check(batches):
        for batch in _text.sliced(batches):
            n, m = batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
            keep = _close(n, m)
            x, y = batch.column("a_odd").to_pylist(), batch.column("b_odd").to_pylist()
            for i in np.flatnonzero(keep):
                u, v = int.from_bytes(x[i], "little"), int.from_bytes(y[i], "little")
                bits = 8 * min(len(x[i]), len(y[i]))
                u, v = (_folded(w, 8 * len(z), bits) for w, z in ((u, x[i]), (v, y[i])))
                keep[i] = (u ^ v).bit_count() <= (n[i] + m[i]) // 7
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return saved(pairs.join(left, "a").join(right, "b").select("a", "b", "a_n", "b_n", "a_odd", "b_odd").mapInArrow(check, "a long, b long"))


def _folded(sketch: int, size: int, bits: int) -> int:
    """An odd sketch of half as many buckets, again and again down to ``bits``."""
    while size > bits:
        size //= 2
        sketch = (sketch >> size) ^ (sketch & (1 << size) - 1)
    return sketch


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the similarity."""
    left, right = (texts.select(F.col("sig").alias(k), F.col("packed").alias(f"{k}_text")) for k in "ab")

    def verify(batches):
        expand = zstandard.ZstdDecompressor()
        for batch in _text.sliced(batches):
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                blobs = part.column("a_text").to_pylist() + part.column("b_text").to_pylist()
                names = list(dict.fromkeys(blobs))
                have = dict(zip(names, _sets_of([expand.decompress(x) for x in names]), strict=True))
                good = []
                for x, y in zip(blobs[: part.num_rows], blobs[part.num_rows :], strict=True):
                    x, y = have[x], have[y]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(good))

    return saved(pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text").mapInArrow(verify, "a long, b long"))


def _bits(band: int) -> int:
    return max(64, 4 << band)


def _parity(sets: list[np.ndarray], band: int) -> np.ndarray:
    """Odd sketches: a bit for each bucket that holds an odd number of shingles.

    Two sets differ in at least as many shingles as their sketches differ in bits.
    """
    bits = _bits(band)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = np.concatenate(sets) & np.uint64(bits - 1) if sets else np.empty(0, dtype=np.uint64)
    odd = np.bincount(row * bits + at.astype(np.int64), minlength=len(sets) * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(sets), bits), axis=1, bitorder="little").view(np.uint64)


def _hard_sets(hot: DataFrame, n_parts: int) -> DataFrame:
    """(sig, n, way, keys): sets with so many hot keys that a link could be lost, and those keys."""

    def hard(batches):
        got = [np.frombuffer(b"".join(batch.column("blob").to_pylist()), dtype=ENTRY) for batch in _text.sliced(batches)]
        if not got:
            return
        e = np.concatenate(got)
        e = e[np.lexsort((e["key"], e["way"], e["sig"]))]
        once = np.ones(len(e), dtype=bool)
        once[1:] = (e["key"][1:] != e["key"][:-1]) | (e["sig"][1:] != e["sig"][:-1])
        e = e[once]
        new = np.ones(len(e), dtype=bool)
        new[1:] = (e["sig"][1:] != e["sig"][:-1]) | (e["way"][1:] != e["way"][:-1])
        first = np.flatnonzero(new)
        bounds = np.append(first, len(e))
        keep = (np.diff(bounds) >= e["need"][first]) & (e["need"][first] < NEVER)
        keys = _text.binary(np.ascontiguousarray(e["key"]), bounds)
        rows = pa.RecordBatch.from_arrays([pa.array(e["sig"][first].copy()), pa.array(e["n"][first].copy()), pa.array(e["way"][first].astype(np.int32)), keys], ["sig", "n", "way", "keys"])
        yield rows.filter(pa.array(keep))

    return saved(hot.repartition(n_parts, "bucket").mapInArrow(hard, "sig long, n int, way int, keys binary"))


def _stars(hard: DataFrame, n_parts: int) -> DataFrame:
    """Blobs of pairs: hard sets with the hub of their size, and hubs with the next hub, for every hot key."""

    def by_key(batches):
        for batch in _text.sliced(batches):
            keys = batch.column("keys").to_pylist()
            size = [len(x) // 8 for x in keys]
            e = np.zeros(sum(size), dtype=ENTRY)
            e["key"] = np.frombuffer(b"".join(keys), dtype=np.uint64)
            for name in ("sig", "n"):
                e[name] = np.repeat(batch.column(name).to_numpy(), size)
            if len(e):
                yield _dealt(_HOT, e, e["key"], n_parts)

    def star(batches):
        got = [np.frombuffer(b"".join(batch.column("blob").to_pylist()), dtype=ENTRY) for batch in _text.sliced(batches)]
        if got:
            e = np.concatenate(got)
            e = e[np.lexsort((e["sig"], e["n"], e["key"]))]
            hub = _hubs(e, e["key"])
            heads = e[np.unique(hub)]
            linked = heads["key"][1:] == heads["key"][:-1]
            p = _pairs(np.concatenate((e["sig"], heads["sig"][1:][linked])), np.concatenate((e["sig"][hub], heads["sig"][:-1][linked])))
            yield _dealt_pairs(p, n_parts)

    return hard.mapInArrow(by_key, _BLOBS).repartition(n_parts, "bucket").mapInArrow(star, _BLOBS)


def _met(g: np.ndarray, own: int, spanning: bool) -> list[np.ndarray]:
    """Pairs of the members of a hot key that sizes and odd sketches do not rule out, of different components.

    own: how many of them are of a first block that is only compared with the rest; 0: all with all.
    """
    if own:
        order = np.argsort(g["n"], kind="stable")
        g, first = g[order], (order < own)
    n, comp, odd, sig = (np.ascontiguousarray(g[k]) for k in ("n", "component", "odd", "sig"))
    ends = np.searchsorted(n, n * 100 // 75, "right")
    label = np.unique(comp, return_inverse=True)[1]
    found = []
    for i in range(len(g) - 1):
        j = np.arange(i + 1, ends[i])
        j = j[label[j] != label[i]]
        if own:
            j = j[first[j] != first[i]]
        differ = np.bitwise_count(odd[j] ^ odd[i]).sum(axis=1)
        near = differ <= (n[i] + n[j]) // 7
        j = j[near]
        if not len(j):
            continue
        if spanning:
            order = np.lexsort((sig[j], differ[near], label[j]))
            names, at = np.unique(label[j[order]], return_index=True)
            j = j[order[at]]
            label[np.isin(label, names)] = label[i]
        found.append(_pairs(np.full(len(j), sig[i]), sig[j]))
    return found


def _second_look(hard: DataFrame, comps: DataFrame, texts: DataFrame, n_parts: int, spanning: bool) -> DataFrame:
    """Pairs of hard sets of one hot key in different components that odd sketches do not rule out.

    spanning: not all of them, but enough to join, if they all hold, whatever all would join.
    """

    members = MEMBERS

    def member(band: int) -> np.dtype:
        return np.dtype([("key", "<u8"), ("sig", "<i8"), ("component", "<i8"), ("n", "<i4"), ("odd", "<u8", (_bits(min(band, SHORT_BAND)) // 64,))])

    def by_key(batches):
        expand = zstandard.ZstdDecompressor()
        for batch in _text.sliced(batches):
            ways = batch.column("way").to_numpy()
            for way in np.unique(ways):
                rows = np.flatnonzero(ways == way)
                load = np.cumsum([len(batch.column("keys")[int(r)].as_py()) // 8 for r in rows])
                for own in np.split(rows, np.flatnonzero(np.diff(load // KEYS_AT_ONCE)) + 1):
                    part = batch.take(pa.array(own))
                    keys = part.column("keys").to_pylist()
                    size = [len(x) // 8 for x in keys]
                    e = np.zeros(sum(size), dtype=member(int(way) // 2))
                    e["key"] = np.frombuffer(b"".join(keys), dtype=np.uint64)
                    for name in ("sig", "n", "component"):
                        e[name] = np.repeat(part.column(name).to_numpy(), size)
                    sets = _sets_of([expand.decompress(x) for x in part.column("packed").to_pylist()])
                    e["odd"] = np.repeat(_parity(sets, min(int(way) // 2, SHORT_BAND)), size, axis=0)
                    yield _dealt(int(way), e, e["key"], n_parts)

    def across(batches):
        got: dict[int, list[bytes]] = {}
        for batch in _text.sliced(batches):
            for way, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                got.setdefault(way, []).append(blob)
        for way, blobs in got.items():
            e = np.frombuffer(b"".join(blobs), dtype=member(way // 2))
            e = e[np.lexsort((e["n"], e["key"]))]
            first = np.flatnonzero(np.concatenate(([True], e["key"][1:] != e["key"][:-1])))
            found = []
            for a, b in zip(first, np.append(first[1:], len(e)), strict=True):
                g = e[a:b]
                if (g["component"] == g["component"][0]).all():
                    continue
                if len(g) <= members:
                    found += _met(g, 0, spanning)
                    continue
                # blocks in the order of size, so that only those of about one size meet
                for i in range(0, len(g), members):
                    most = g["n"][min(i + members, len(g)) - 1] * 100 // 75
                    for j in range(i, len(g), members):
                        if g["n"][j] > most:
                            break
                        part = g[i : i + members] if i == j else np.concatenate((g[i : i + members], g[j : j + members]))
                        bucket = int(_text.mix(g["key"][:1] + np.uint64(i * len(g) + j))[0] % np.uint64(n_parts))
                        own = 0 if i == j else members
                        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([_UNIT + way], pa.int32()), pa.array([own.to_bytes(4, "little") + part.tobytes()])], ["bucket", "kind", "blob"])
            if found:
                yield _dealt_pairs(_once(np.concatenate(found)), n_parts)

    def units(batches):
        for batch in batches:
            for way, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                found = _met(np.frombuffer(blob, dtype=member((way - _UNIT) // 2), offset=4), int.from_bytes(blob[:4], "little"), spanning)
                if found:
                    yield _dealt_pairs(_once(np.concatenate(found)), n_parts)

    rows = hard.join(comps.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    rows = rows.join(texts.select("sig", "packed"), "sig").select("sig", "n", "way", "keys", "component", "packed")
    dealt = saved(rows.mapInArrow(by_key, _BLOBS).repartition(n_parts, "bucket").mapInArrow(across, _BLOBS))
    split = dealt.where(F.col("kind") >= _UNIT).repartition(n_parts, "bucket").mapInArrow(units, _BLOBS)
    return _distinct_pairs(dealt.where(F.col("kind") < _UNIT).unionAll(split), n_parts)


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of x shares with each set of y."""
    sets = x + y
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    row, at = row[shared[at]], (np.cumsum(shared) - 1)[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    for k in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(at, (k, k + COLUMNS))
        part = np.zeros((len(sets), at[b - 1] - k + 1), dtype=np.float32)
        part[row[a:b], at[a:b] - k] = 1
        out += (part[: len(x)] @ part[len(x) :].T).astype(np.int64)
    return out


def _block_links(lo: int, hi: int, members: list[tuple], percent: int) -> list[tuple[int, int]]:
    """(sig, links) of members (sig, copies, block, set) with those of the other block, or of their own one."""
    x, y = ([m for m in members if m[2] == k] for k in (lo, hi))
    if not x or not y:
        return []
    both = _overlaps([m[3] for m in x], [m[3] for m in y])
    size, other = (np.array([len(m[3]) for m in own]) for own in (x, y))
    near = 100 * both >= percent * (size[:, None] + other - both)
    if lo == hi:
        np.fill_diagonal(near, False)
    found = list(zip([m[0] for m in x], (near @ np.array([m[1] for m in y])).tolist(), strict=True))
    if lo != hi:
        found += zip([m[0] for m in y], (near.T @ np.array([m[1] for m in x])).tolist(), strict=True)
    return found


def _links(members: DataFrame, texts: DataFrame, percent: int, n_parts: int) -> DataFrame:
    """(sig, links): documents of other classes that the classes (sig, copies, component) are linked with."""
    sized = members.join(texts.select("sig", "n"), "sig").groupBy("component")
    blocks = saved(sized.agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    rows = members.join(small(blocks), "component").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    rows = rows.join(texts.select("sig", "packed"), "sig").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "sig", "copies", "packed")

    def compare(batches):
        expand = zstandard.ZstdDecompressor()
        key, held = None, []
        for batch in _text.sliced(batches, 250):
            found = []
            sets = _sets_of([expand.decompress(t) for t in batch.column("packed").to_pylist()])
            names, own = (zip(*(batch.column(k).to_pylist() for k in some), strict=True) for some in (("component", "lo", "hi"), ("sig", "copies", "block")))
            for name, member, s in zip(names, own, sets, strict=True):
                if name != key:
                    found += _block_links(*key[1:], held, percent) if key else []
                    key, held = name, []
                held.append((*member, s))
            yield links_batch(found)
        if key:
            yield links_batch(_block_links(*key[1:], held, percent))

    def links_batch(found):
        sig, n = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(n, pa.int64())], ["sig", "links"])

    dealt = rows.repartition(n_parts, "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    return saved(dealt.mapInArrow(compare, "sig long, links long")).groupBy("sig").agg(F.sum("links").alias("links"))


def row_key(docs: DataFrame) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(docs["text"].cast("string"))


def near_duplicates(docs: DataFrame, percent: int = 75, max_group: int = MAX_GROUP, links: bool = False, keys: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    links: with n_links, the number of other documents whose sets reach the similarity.
    keys: with row (the text's hash) and family, which tell rows and components apart where
    doc_ids repeat; family is null for a row that is alone.
    percent must be 75 or more: the segment counts are laid out for that.
    """
    if percent < 75:
        raise ValueError("percent must be 75 or more")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n_parts = partitions(docs, 2.0)

    for salt in range(SALTS):
        found = _candidates(docs.withColumn("row", row_key(docs)) if keys else docs, n_parts, max_group, salt)
        light = _documents(found)
        classes, clash = light.where("doc_id is not null and n_shingles > 0").groupBy("sig"), Observation()
        classes = classes.agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("check").alias("check"), F.max("check").alias("other"))
        classes = saved(classes.observe(clash, F.count_if(F.col("check") != F.col("other")).alias("n")).select("sig", "least", "copies"))
        if not clash.get["n"]:
            break
    else:
        raise RuntimeError(f"different sets share a name under each of {SALTS} salts")
    hard = _hard_sets(found.where(F.col("kind") == _HOT), n_parts)
    blobs = found.where(F.col("kind") == _STARS).unionAll(_stars(hard, n_parts))
    pairs = saved(_distinct_pairs(blobs, n_parts))
    ends = pairs.select(F.col("a").alias("sig")).unionAll(pairs.select(F.col("b").alias("sig"))).unionAll(hard.select("sig"))
    texts = _class_texts(docs, classes, ends.distinct(), salt)
    edges = _verified(_plausible(pairs, texts), texts, percent)
    comps = components(edges)
    for spanning in (True,) * SPANNING_ROUNDS + (False,) if hard.limit(1).count() else ():
        more = saved(_second_look(hard, comps, texts, n_parts, spanning))
        if not more.limit(1).count():
            break
        found_now = _verified(_plausible(more, texts), texts, percent)
        if found_now.limit(1).count():
            edges = edges.unionAll(found_now)
            comps = components(edges)
    classes = classes.join(comps, classes.sig == comps.node, "left").select("sig", "least", "copies", "component")
    classes = saved(classes.where("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "sig")))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    names = classes.join(smallest, "component").select("sig", "copies", "component_id", F.col("component").alias("family"))
    if links:
        members = classes.join(comps.select(F.col("node").alias("sig")), "sig", "left_semi").select("sig", "copies", "component")
        names = names.join(_links(members, texts, percent, n_parts), "sig", "left").select("*", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    names = saved(names.drop("copies", "links"))
    known = F.col("doc_id").isNotNull()
    columns = ["doc_id", "n_shingles", F.when(known, F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))).alias("component_id")]
    if links:
        columns.append(F.when(known, F.coalesce("n_links", F.lit(0).cast("long"))).alias("n_links"))
    if keys:
        columns += ["row", F.when(known, F.col("family")).alias("family")]
    return light.join(small(names), "sig", "left").select(*columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), links=True)


ORACLE = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE_WORDS - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT node, min(other) AS least FROM r GROUP BY node),
k AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id, CAST(coalesce(k.links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""
