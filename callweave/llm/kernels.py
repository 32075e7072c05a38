"""Numpy kernels over Arrow text columns: words, their 64-bit hashes and shingles, without a Python object per word.

A batch's text column is one byte buffer with offsets, so a word is a run of bytes that separate no words.
Word hashes are polynomials modulo 2**64 over fixed random 64-bit values of the bytes (A-Z count as a-z), with a
finaliser; shingle hashes are multilinear in the word hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240131)
_BYTES = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z hash as a-z
_BASE = U(0x9E3779B97F4A7C17)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_STRETCH = 1 << 17
_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
_WIDE = _RNG.integers(1, 2**64 - 1, 64, dtype=np.uint64) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = int(offsets[-1]) if len(offsets) else 0
    raw = np.frombuffer(data, np.uint8)[:size] if data is not None and size else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return raw[first:], offsets - first


#: Bytes that separate words: space and tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words of a batch: starts and ends in the buffer, the text each lies in, and bounds of each text's words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK):
        n = len(raw)
        inside = ~blank[raw]
        first = np.zeros(n, bool)
        first[offsets[:-1][offsets[:-1] < n]] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:]
        self.raw, self.offsets = raw, offsets
        self.inside = inside
        self.starts = np.flatnonzero(starts)
        self.bounds = np.searchsorted(self.starts, offsets)  # words of text i: bounds[i]:bounds[i + 1]
        self.counts = np.diff(self.bounds)

    def ends(self) -> np.ndarray:
        """One past each word's last byte."""
        last = np.concatenate([self.starts[1:], [len(self.raw)]])
        # within starts[i]:last[i] a word's bytes come first
        blanks = np.concatenate([[0], np.cumsum(~self.inside)])
        return last - (blanks[last] - blanks[self.starts])

    def hashes(self) -> np.ndarray:
        """One hash a word."""
        return run_hashes(self.raw, self.starts, self.ends())


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash a run of bytes (runs ascend): differences of running polynomial sums, in stretches that fit the processor's cache."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, low + _STRETCH)))
        high = ends[to - 1]
        powers, inverses = _powers(int(high - low))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTES[raw[low:high]] * powers[: high - low], out=sums[1:])
        begin = starts[at:to] - low
        out[at:to] = (sums[ends[at:to] - low] - sums[begin]) * inverses[begin]
        at = to
    return mix(out)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POWERS[0]):
        size = max(n, 2 * _STRETCH)
        _POWERS[:] = [np.cumprod(np.concatenate([[U(1)], np.full(size, x, np.uint64)]).astype(np.uint64)) for x in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): each sequence's shingles of `width` words; a shorter one is one shingle, an empty one none."""
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.uint64), sizes
    word_base = np.concatenate([[0], np.cumsum(counts)])[:-1]
    owner = np.repeat(np.arange(len(counts)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    at = word_base[owner] + (np.arange(total) - begin[owner])
    out = np.zeros(total, np.uint64)
    length = np.minimum(counts[owner], width)
    if (length == width).all():
        for j in range(width):
            out += words[at + j] * _WIDE[j]
    else:
        for j in range(width):
            there = j < length
            out[there] += words[at[there] + j] * _WIDE[j]
        out += length.astype(np.uint64) * _WIDE[63]
        out -= np.uint64(width * int(_WIDE[63]) % 2**64)
    return mix(out), sizes


def distinct_in_groups(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each group's distinct values in ascending order, and how many."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = grouped_order(values, owner, np.zeros(len(values), np.uint64), 0)
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(counts))


def grouped_order(values: np.ndarray, owner: np.ndarray, rank: np.ndarray, bits: int) -> np.ndarray:
    """The order by (owner, rank, value): one sort of 64-bit keys that hold the owner, the rank (of so many bits) and the
    value's first bits; the few values that agree in those are put in order after it."""
    if len(values) < 2:
        return np.arange(len(values))
    wide = int(owner[-1]).bit_length()
    spare = 64 - wide - bits
    if spare < 24:
        return np.lexsort((values, rank, owner))
    key = (owner.astype(np.uint64) << U(64 - wide)) if wide else np.zeros(len(values), np.uint64)
    if bits:
        key |= rank << U(spare)
    key |= values >> U(64 - spare) if spare < 64 else values
    order = np.argsort(key)
    key, sorted_values = key[order], values[order]
    alike = (key[1:] == key[:-1]) & (sorted_values[1:] < sorted_values[:-1])
    return np.lexsort((values, rank, owner)) if alike.any() else order


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow binary column: group i holds the little-endian bytes of its values."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * values.dtype.itemsize
    kind, dtype = (pa.binary(), np.int32) if offsets[-1] < 2**31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(counts), [None, pa.py_buffer(offsets.astype(dtype)), pa.py_buffer(np.ascontiguousarray(values))])


def slices(batch: pa.RecordBatch, text: str = "text", size: int = 1 << 20):
    """A batch in parts of about `size` bytes of text (one row at least), which stay in the processor's cache."""
    column = batch.column(text)
    _, offsets = text_buffer(column)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
