"""CRC-32 of many byte strings at once, and of their concatenations, in numpy."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

#: Lengths with a table of their own.
SHORT = 64


def _step(rows: np.ndarray) -> np.ndarray:
    """Each CRC after one more zero byte."""
    return byte_table()[rows & 0xFF] ^ (rows >> np.uint32(8))


@cache
def byte_table() -> np.ndarray:
    """The table of the CRC-32 polynomial, one number a byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1)).astype(np.uint32)
    return table


def _spread(images: np.ndarray) -> np.ndarray:
    """(4, 256) table of a linear map of 32 bits, from the images of the 32 unit numbers."""
    table = np.zeros((4, 256), dtype=np.uint32)
    for k in range(4):
        for bit in range(8):
            table[k, (np.arange(256) >> bit & 1).astype(bool)] ^= images[8 * k + bit]
    return table


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 0xFF] ^ table[1][x >> 8 & 0xFF] ^ table[2][x >> 16 & 0xFF] ^ table[3][x >> 24]


@cache
def _short() -> np.ndarray:
    """(SHORT, 4, 256): the map that n zero bytes make of a CRC, for each n."""
    images, out = np.uint32(1) << np.arange(32, dtype=np.uint32), np.empty((SHORT, 4, 256), dtype=np.uint32)
    for n in range(SHORT):
        out[n] = _spread(images)
        images = _step(images)
    return out


@cache
def _doubled(k: int) -> np.ndarray:
    """The map of 2^k zero bytes."""
    if k == 0:
        return _short()[1]
    half = _doubled(k - 1)
    return _spread(_apply(half, _apply(half, np.uint32(1) << np.arange(32, dtype=np.uint32))))


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What each CRC adds to that of a string with n more bytes: crc32(a + b) = shifted(crc32(a), len(b)) ^ crc32(b)."""
    flat = _short().ravel()
    at = np.minimum(n, SHORT - 1).astype(np.int64) << 10
    x = crc.astype(np.uint32)
    out = flat[at + (x & 0xFF)] ^ flat[at + 256 + (x >> 8 & 0xFF)] ^ flat[at + 512 + (x >> 16 & 0xFF)] ^ flat[at + 768 + (x >> 24)]
    far = np.flatnonzero(n >= SHORT)
    if len(far):
        value, left = x[far], n[far].astype(np.int64)
        for k in range(int(left.max()).bit_length()):
            odd = (left >> k & 1).astype(bool)
            value[odd] = _apply(_doubled(k), value[odd])
        out[far] = value
    return out


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[start:end] (uint8)."""
    lengths, table = ends - starts, byte_table()
    crc = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    live = np.flatnonzero(lengths < SHORT)
    live = live[np.argsort(-lengths[live], kind="stable")]
    sorted_lengths = -lengths[live]
    for k in range(int(lengths[live[0]]) if len(live) else 0):
        live = live[: np.searchsorted(sorted_lengths, -k, side="left")]
        c = crc[live]
        crc[live] = table[(c ^ data[starts[live] + k]) & 0xFF] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths >= SHORT).tolist():
        crc[i] = zlib.crc32(data[starts[i] : ends[i]])
    return crc
