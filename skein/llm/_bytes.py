"""Byte-level numpy kernels shared by the text operators.

Texts arrive as Arrow string columns.  A kernel sees them as one uint8 buffer plus
row offsets, a bounded chunk of rows at a time, so memory follows the chunk and the
longest single text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 2 << 20
SPACE = 0x20
#: Odd 64-bit multipliers of the polynomial hashes and the final mixers.
BASE = U64(0x9E3779B97F4A7C15)
STEP = U64(0xC2B2AE3D27D4EB4F)
MIX = U64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]+` on bytes.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on lower-cased bytes.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most `limit` bytes (one row at least)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def separated(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, sep: int = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Texts lo..hi with one separator byte after each, and the start of each (and of the end)."""
    part = data[offsets[lo] : offsets[hi]]
    starts = offsets[lo : hi + 1] - offsets[lo] + np.arange(hi - lo + 1)
    out = np.empty(len(part) + hi - lo, np.uint8)
    text = np.ones(len(out), bool)
    text[starts[1:] - 1] = False
    out[text] = part
    out[starts[1:] - 1] = sep
    return out, starts


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(BASE, 4096)


def _base_powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = powers(BASE, 2 * n)
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h *= MIX
    h ^= h >> U64(29)
    return h


def words(buf: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each maximal run of alphabet bytes; letters are widened a bounded piece at a time."""
    inside = alphabet[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    h = np.empty(len(start), U64)
    size = end - start
    total = np.cumsum(size)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK_BYTES, side="right")))
        own = size[lo:hi]
        first = np.zeros(len(own), np.int64)
        np.cumsum(own[:-1], out=first[1:])
        piece = slice(start[lo], end[hi - 1])
        letters = buf[piece][inside[piece]].astype(U64)
        letters += U64(1)
        place = np.arange(len(letters), dtype=np.int64)
        place -= np.repeat(first, own)
        letters *= _base_powers(int(own.max()) + 1)[place]
        h[lo:hi] = mixed(np.add.reduceat(letters, first))
        lo = hi
    return start, end, h


def rows_of_words(word_starts: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """First word of each text, and the number of words at the end."""
    return np.searchsorted(word_starts, text_starts, side="left")


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k items from each position; positions near the end are cut off."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= STEP
        out += h[j : n + j]
    return mixed(out)


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: high bytes that are mostly zeros compress to nothing."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unplanes(raw: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
