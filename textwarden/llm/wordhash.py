"""Words and word n-grams of Arrow text columns as 64-bit hashes, in whole-batch numpy.

Words are maximal runs of bytes other than space and 0x09 to 0x0D; in UTF-8
these bytes never occur inside another character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256).astype(np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Texts of a batch are worked on in pieces of about so many bytes, to bound memory.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, nulls as empty, and the n + 1 offsets of its rows."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about PIECE bytes each; a longer row is a piece of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, side="right")) - 1)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word crosses rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, of A-Z in lower case if asked for."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    power = np.full(int(lengths.max()), STEP, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    table = BYTE[LOWER] if lower else BYTE
    values = table[data[place + np.repeat(starts, lengths)]] * power[place]
    return mix(np.add.reduceat(values, begin) + lengths.astype(np.uint64))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word; the last n - 1 are missing."""
    total = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64)
    for k in range(n):
        total = total * STEP + hashes[k : k + len(total)]
    return mix(total + np.uint64(n))


def row_keys(hashes: np.ndarray, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's sequence of words."""
    first = np.searchsorted(starts, at)
    with np.errstate(over="ignore"):
        return np.array([int(mix(hashes[a:b] + np.arange(b - a, dtype=np.uint64)).sum().astype(np.int64)) for a, b in zip(first[:-1], first[1:], strict=True)], np.int64)


def ngram_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 63-bit hashes of its word n-grams, A-Z in lower case.

    A text of fewer words has its whole word sequence as the one member, a text
    without words the empty set.
    """
    data, offsets = text_bytes(column)
    for lo, hi in pieces(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        part = data[offsets[lo] : offsets[hi]]
        starts, ends = words(part, at)
        hashes = word_hashes(part, starts, ends)
        grams = ngram_hashes(hashes, n) >> np.uint64(1)
        first = np.searchsorted(starts, at)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield ngram_hashes(hashes[a:b], int(b - a)) >> np.uint64(1)
            else:
                yield np.zeros(0, np.uint64)
