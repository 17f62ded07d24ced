"""Words of UTF-8 text columns, found and hashed on bytes with numpy.

Both word classes in use leave every non-ASCII character inside a word, so a byte table is exact.
Text is taken in groups of about `BLOCK` bytes; a longer text is cut at a byte outside words, so
memory beyond the text itself is eight bytes per word plus one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: One odd factor for each place of an n-gram.
PLACES = _RNG.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_table(inside) -> np.ndarray:
    return np.fromiter((inside(b) for b in range(256)), bool, 256)


#: Everything but space and \t \n \v \f \r.
NOT_SPACE = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Digits, ASCII letters and every non-ASCII character.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
AS_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


class Words(NamedTuple):
    """Words of texts `lo` to `hi`: hash, first and last-plus-one byte, and where each text's words begin."""

    lo: int
    hi: int
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, "") if column.null_count else column
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return at.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _hashes(data: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    begin = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=begin[1:])
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    power = np.full(int(size.max()), _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    return mix(np.add.reduceat(_BYTE[data[inside]] * power[place], begin))


def words(at: np.ndarray, data: np.ndarray, inside: np.ndarray, lower: bool) -> Iterator[Words]:
    """Words of every text, in groups of texts of about BLOCK bytes."""
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK, side="right")) - 1)
        a, b = int(at[lo]), int(at[hi])
        parts, p = [], a
        while p < b:
            q = min(p + BLOCK, b)
            while q < b and inside[data[q - 1]] and inside[data[q]]:
                q += 1
            raw = data[p:q]
            is_word = inside[raw]
            edge = np.zeros(q - p + 1, bool)
            edge[at[(at >= p) & (at < q)] - p] = True
            edge[0] = edge[-1] = True
            start = np.flatnonzero(is_word & (edge[:-1] | ~np.concatenate(([False], is_word[:-1]))))
            end = np.flatnonzero(is_word & (edge[1:] | ~np.concatenate((is_word[1:], [False])))) + 1
            parts.append((_hashes(AS_LOWER[raw] if lower else raw, is_word, start, end), start + p, end + p))
            p = q
        h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield Words(lo, hi, h, s, e, np.searchsorted(s, at[lo : hi + 1]))
        lo = hi


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the caller leaves out those that cross texts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1] * PLACES[0]
    for j in range(1, n):
        out = out + hashes[j : len(hashes) - n + 1 + j] * PLACES[j]
    return mix(out + np.uint64(n))
