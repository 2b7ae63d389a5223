"""CRC-32C (Castagnoli) of many values at once; Spark has no function for it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np

ONES = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _table()[(state ^ byte) & 255] ^ (state >> 8)


@cache
def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> 1) ^ np.where(out & 1, np.uint32(0x82F63B78), np.uint32(0))
    return out


@cache
def _preset() -> bytes:
    """Four bytes that take an empty register to all ones, where a checksum starts."""
    table = [int(x) for x in _table()]
    by_top = {x >> 24: k for k, x in enumerate(table)}
    want, path = int(ONES), []
    for _ in range(4):
        path.insert(0, by_top[want >> 24])
        want = (want ^ table[path[0]]) << 8 & int(ONES)
    state, out = 0, []
    for k in path:
        out.append(k ^ state & 255)
        state = table[k] ^ state >> 8
    return bytes(out)


@cache
def _over_zeros(n: int) -> np.ndarray:
    """What ``n`` zero bytes make of each byte of a register: 4 tables of 256."""
    state = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], dtype=np.uint32)
    for _ in range(n):
        state = _step(state, 0)
    return state


def crc32c(values: Sequence[bytes]) -> np.ndarray:
    """The checksum of each value.

    Values are cut into lanes of one length, all lanes go through the register side by side, and
    the lanes of a value are folded in order: steps grow with the root of the longest value.
    """
    if not len(values):
        return np.zeros(0, dtype=np.uint32)
    longest = max(map(len, values)) + 4
    lane = 1 << max(4, (longest.bit_length() + 1) // 2)
    count = np.array([-(-(len(v) + 4) // lane) for v in values])
    whole = b"".join(bytes(int(n) * lane - len(v) - 4) + _preset() + v for v, n in zip(values, count, strict=True))
    lanes = np.ascontiguousarray(np.frombuffer(whole, dtype=np.uint8).reshape(-1, lane).T)
    state = np.zeros(lanes.shape[1], dtype=np.uint32)
    for column in lanes:
        state = _step(state, column)
    first, over = np.cumsum(count) - count, _over_zeros(lane)
    out = np.zeros(len(values), dtype=np.uint32)
    for k in range(count.max()):
        own = np.flatnonzero(count > k)
        r = out[own]
        out[own] = over[0][r & 255] ^ over[1][r >> 8 & 255] ^ over[2][r >> 16 & 255] ^ over[3][r >> 24] ^ state[first[own] + k]
    return out ^ ONES
