"""Vectorised text scanning shared by the operators: Arrow columns as byte buffers, words as spans and hashes.

Memory: a batch is cut into slices of about SLICE_BYTES of text (a longer text is a slice of its own), and
hashing takes HASH_BYTES of a slice at a time, so peak memory follows the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
HASH_BYTES = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_tables: dict[str, np.ndarray] = {}


def lower_table() -> np.ndarray:
    """Byte table that maps A-Z to a-z and leaves the rest."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def class_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean byte table, true in the inclusive ranges."""
    t = np.zeros(256, dtype=bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


LOWER = lower_table()
#: Words of letters, digits and all non-ASCII bytes, after lower-casing.
ALNUM = class_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Words of everything but ASCII white space.
NONSPACE = ~class_table((0x20, 0x20), (0x09, 0x0D))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes with a space after each text, bounds) of consecutive rows.

    Row k of the slice is data[bounds[k]:bounds[k + 1] - 1]. Nulls count as empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column, b"")
    n = len(column)
    if n == 0:
        return
    _, offs, vals = column.buffers()
    ends = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(vals, dtype=np.uint8) if vals is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1)
        lens = np.diff(ends[first : last + 1])
        bounds = np.concatenate([[0], np.cumsum(lens + 1)])
        out = np.full(int(bounds[-1]), 0x20, dtype=np.uint8)
        if last - first == 1:
            out[: lens[0]] = data[ends[first] : ends[last]]
        else:
            keep = np.ones(out.size, dtype=bool)
            keep[bounds[1:] - 1] = False
            out[keep] = data[ends[first] : ends[last]]
        yield first, out, bounds
        first = last


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; data ends with a byte that is not in a word."""
    m = is_word[data].view(np.int8)
    edge = np.flatnonzero(np.diff(m, prepend=np.int8(0)))
    return edge[0::2], edge[1::2]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _tables or _tables["pow"].size < n:
        size = max(n, HASH_BYTES + 1024)
        inverse = pow(_P, -1, 1 << 64)
        for name, base in (("pow", _P), ("inv", inverse)):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["pow"], _tables["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same in every process."""
    out = np.empty(starts.size, dtype=np.uint64)
    i = 0
    while i < starts.size:
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + HASH_BYTES, side="right")))
        seg = data[base : int(ends[j - 1])]
        power, inverse = _powers(seg.size + 1)
        sums = np.zeros(seg.size + 1, dtype=np.uint64)
        np.cumsum((seg.astype(np.uint64) + np.uint64(1)) * power[: seg.size], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        i = j
    return out


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive word hashes; entry i is the run that begins at word i."""
    count = words.size - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(count, dtype=np.uint64)
    factor = 1
    for k in range(n):
        h += words[k : k + count] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 & _MASK
    return mix(h + np.uint64(n))


def words_per_text(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Index of each text's first word, and the number of words at the end."""
    return np.searchsorted(starts, bounds)
