"""Texts of an Arrow column as flat numpy arrays: words, word hashes, windows.

All functions work on whole texts. Bytes are UTF-8; the white space of the
query contracts is ASCII, so words are runs of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random odd base and random values of the 256 bytes for hashing.
_RNG = np.random.default_rng(7)
_BASE = _RNG.integers(0, 1 << 64, dtype=np.uint64) | np.uint64(1)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS = np.cumprod(np.full(64, _BASE))
#: Bytes that are hashed at a time.
_STEP = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (splitmix64's last steps)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other and the offsets of the texts
    (one more than texts); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`flat`, for a column of bytes without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32 if column.type == pa.binary() else np.int64)
    at = at[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw[at[0]:at[-1]]), at - at[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of words in
    the texts before it (one entry more than texts)."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        before[0], before[1:] = True, space[:-1]
        after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), _BASE))
    return _POWERS


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word (of its ASCII lower case, if ``lower``)."""
    out = np.empty(len(starts), dtype=np.uint64)
    values = _BYTE[_LOWER] if lower else _BYTE
    lengths = ends - starts
    upto = np.cumsum(lengths)
    powers = _powers(int(lengths.max()) + 1 if len(lengths) else 1)
    a = 0
    while a < len(starts):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + _STEP)))
        n = lengths[a:b]
        first = np.concatenate(([0], np.cumsum(n)[:-1]))
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        terms = values[data[np.repeat(starts[a:b], n) + place]] * powers[place]
        out[a:b] = mix(np.add.reduceat(terms, first) + n.astype(np.uint64))
        a = b
    return out


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of ``size`` words of a text, in order, and the
    bounds of the texts' runs. A text of fewer words (but one) has one run of
    all its words."""
    counts = np.diff(bounds)
    powers = _powers(size + 1)
    rolled = np.zeros(max(0, len(hashes) - size + 1), dtype=np.uint64)
    for j in range(size if len(rolled) else 0):
        rolled += hashes[j:len(rolled) + j] * powers[j]
    rolled = mix(rolled)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    out_bounds = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(int(out_bounds[-1]), dtype=np.uint64)
    whole = counts >= size
    keep = np.zeros(len(rolled), dtype=np.int8)
    if len(rolled):  # marks the starts whose run stays inside a text
        np.add.at(mark := np.zeros(len(rolled) + 1, dtype=np.int64), bounds[:-1][whole], 1)
        np.add.at(mark, bounds[:-1][whole] + n[whole], -1)
        keep = np.cumsum(mark[:-1]) > 0
    is_long = np.repeat(whole, n)
    out[is_long] = rolled[keep] if len(rolled) else rolled
    short = np.flatnonzero((counts > 0) & ~whole)
    for i in short:
        part = hashes[bounds[i]:bounds[i + 1]]
        out[out_bounds[i]] = mix(np.array([(part * powers[:len(part)]).sum() + np.uint64(len(part))], dtype=np.uint64))[0]
    return out, out_bounds


def pieces(bounds: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    """Runs ``(a, b)`` of texts that hold about ``step`` items together, by
    their bounds; a larger text is a run of its own."""
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + step, side="right")) - 1)
        yield a, b
        a = b


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and the place of each value among them (as
    ``np.unique``, but only the distinct ones are sorted)."""
    coded = pa.array(values).dictionary_encode()
    found = coded.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(found)
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return found[order], rank[coded.indices.to_numpy(zero_copy_only=False)]
