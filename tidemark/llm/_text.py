"""Vectorised word hashing shared by the text operators.

Texts are handled as UTF-8 bytes.  A word is a maximal run of bytes outside
``[\\x20\\x09-\\x0D]``; ``bytes.split()`` cuts at exactly those six bytes.  All
hashes are deterministic across processes, and computed with numpy over a chunk of
documents at a time, so memory is bounded by ``CHUNK_BYTES`` plus one document.

A word's hash is 64 bits of its bytes themselves (16 bytes are mixed in whole, longer words go
through XXH3-128), so no family of words collides by construction.  Windows of words
have Rabin-Karp hashes modulo primes: two residues of 31 bits make the 64-bit hash, a
third one is there for those who compare windows across a whole corpus.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch that are turned into Python objects at once.
SLICE_ROWS = 1000
#: Moduli of the window hashes, and the base of each.
_PRIMES = (2147483647, 2147483629, 2147483587)
_BASES = (1540483477, 1103515245, 1831565813)
_LANES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x2545F4914F6CDD1D)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_powers: dict[tuple[int, int], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _power(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo a prime, kept per process and grown on demand."""
    have = _powers.get((base, prime))
    if have is None or len(have) < n:
        have = np.ones(1, dtype=np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate((have, have * np.uint64(pow(base, len(have), prime)) % np.uint64(prime)))
        _powers[base, prime] = have
    return have[:n]


def residue(values: np.ndarray, width: int, k: int) -> np.ndarray:
    """The Rabin-Karp hash modulo the k-th prime of every ``width`` consecutive values."""
    n, prime = len(values), np.uint64(_PRIMES[k])
    if n < width:
        return np.empty(0, dtype=np.uint64)
    digits = values >> np.uint64(33) if k == 0 else values & np.uint64(0x7FFFFFFF) if k == 1 else mix(values ^ _LANES[2]) >> np.uint64(33)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(digits * _power(_BASES[k], _PRIMES[k], n) % prime, out=sums[1:])
    back = _power(pow(_BASES[k], -1, _PRIMES[k]), _PRIMES[k], n - width + 1)
    return (sums[width:] - sums[:-width]) % prime * back % prime


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every ``width`` consecutive values (len - width + 1 of them)."""
    return mix((residue(values, width, 0) << np.uint64(31)) | residue(values, width, 1))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words at raw[start:end]."""
    size = end - start
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate((raw, np.zeros(16, dtype=np.uint8))), 16)[start]
    lanes = np.ascontiguousarray(lanes).view("<u8").reshape(-1, 2)
    first = lanes[:, 0] & _MASKS[np.minimum(size, 8)]
    second = lanes[:, 1] & _MASKS[np.clip(size - 8, 0, 8)]
    long = np.flatnonzero(size > 16)
    if len(long):
        view = memoryview(np.ascontiguousarray(raw))
        digest = b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True))
        found = np.frombuffer(digest, dtype="<u8").reshape(-1, 2)
        first[long], second[long] = found[:, 0], found[:, 1]
    return mix(mix(first ^ _LANES[0]) + second + size.astype(np.uint64) * _LANES[1])


class Chunk:
    """Some documents as one byte buffer: words joined by one space, documents by a newline.

    rows: index of each document in its Arrow batch; first: index of its first word
    (one more entry at the end); start/end: byte span of each word; hash: word hashes.
    """

    def __init__(self, rows: list[int], norms: list[bytes], lower: bool = False):
        self.rows = rows
        self.data = b"\n".join(norms) + b"\n"
        raw = np.frombuffer(self.data, dtype=np.uint8)
        if lower:
            raw = _LOWER[raw]
        self.bytes = raw
        breaks = np.flatnonzero((raw == 32) | (raw == 10))
        starts = np.concatenate((np.zeros(1, dtype=np.int64), breaks[:-1] + 1))
        real = breaks > starts
        self.start, self.end = starts[real], breaks[real]
        self.hash = word_hashes(raw, self.start, self.end)
        ends = np.cumsum([len(x) + 1 for x in norms])
        self.first = np.concatenate((np.zeros(1, dtype=np.int64), np.searchsorted(self.start, ends)))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all windows inside one document, their first word, their document."""
        every = rolling(self.hash, width)
        at, doc = self.inside(every, width)
        return every[at], at, doc

    def inside(self, every: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows of a whole chunk, those that lie in one document, and that document."""
        doc = np.repeat(np.arange(len(self.rows)), self.counts)[: len(every)]
        inside = np.arange(len(every)) + width <= self.first[1:][doc]
        at = np.flatnonzero(inside)
        return at, doc[at]


def chunks(texts: list[bytes], lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut the texts of one Arrow batch into chunks of about ``limit`` bytes; every text is whole."""
    rows: list[int] = []
    norms: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        norm = b" ".join(text.split())
        if rows and size + len(norm) > limit:
            yield Chunk(rows, norms, lower)
            rows, norms, size = [], [], 0
        rows.append(i)
        norms.append(norm)
        size += len(norm) + 1
    if rows:
        yield Chunk(rows, norms, lower)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices; after the last one, freed memory goes back to the system."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices data[bounds[i]:bounds[i+1]] of a numeric array as one binary column."""
    offsets = (np.asarray(bounds, dtype=np.int64) * data.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
