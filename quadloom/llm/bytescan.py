"""Whole-text scans in numpy: words, hashes and windows over Arrow string columns.

Texts are read as one buffer of UTF-8 bytes with row offsets, in chunks of
bounded size (one text longer than that is a chunk of its own), so memory
follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK = 512 << 10

#: The white space between words: \x20 and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


#: A random value for each byte, and the base of the rolling hash with its inverse modulo 2^64.
BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and base^-0.. of at least ``n`` entries; grown by doubling, kept up to four chunks."""
    up, down = _powers
    if len(up) < n:
        size = 1 << (n - 1).bit_length()
        up, down = np.full(size, BASE, U64), np.full(size, INVERSE, U64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if size <= 4 * CHUNK:
            _powers[:] = [up, down]
    return up, down


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that ``gap`` doesn't mark; no run crosses a row.

    With the default gap these are the words ``[^\\x20\\x09-\\x0D]+``.
    """
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    space = gap[buf]
    before = np.empty(len(buf), bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(len(buf), bool)
    after[-1] = True
    after[:-1] = space[1:]
    full = offs[1:] > offs[:-1]
    before[offs[:-1][full]] = True
    after[offs[1:][full] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, by one rolling sum over the buffer."""
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE[buf] * up[: len(buf)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def windows(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-word windows, and where each starts; none crosses a row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = hashes[:m].copy()
    for i in range(1, n):
        total *= U64(BASE)
        total += hashes[i : i + m]
    at = np.flatnonzero(row[:m] == row[n - 1 : n - 1 + m])
    return mix64(total[at]), at


def fold(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes made different between rows."""
    return mix64(hashes + (row.astype(U64) + U64(1)) * U64(0xC2B2AE3D27D4EB4F))


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` for rows 0 to n - 1, as int64."""
    return np.bincount(row, weights=values, minlength=n).astype(np.int64)
