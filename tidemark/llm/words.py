"""Words of whole texts as numpy arrays: where they are and 64-bit hashes of them and of their n-grams.

A word is a run of bytes other than space and \\t..\\r, which for UTF-8 is `[^\\x20\\x09-\\x0D]+` on code points.
Null texts have no words. All functions work on slices of bounded bytes, one long text being a slice of its own."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
UPPER = np.arange(256, dtype=np.uint8)
UPPER[65:91] += 32
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n, kept between calls."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        known = np.ones(size, np.uint64)
        step, done = base % (1 << 64), 1
        while done < size:
            known[done:2 * done] = known[:done] * np.uint64(step)
            step, done = step * step % (1 << 64), 2 * done
        _POWERS[base] = known
    return known[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of unsigned 64-bit values."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.large_string())


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (one more than there are texts)."""
    column = as_strings(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if column.null_count:  # what lies under a null may be anything
        lengths = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        if lengths.sum() != offsets[-1] - offsets[0]:
            return text_bytes(column.fill_null(""))
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


class Words:
    """starts, ends: bytes of each word in `data`; first: index of each document's first word, one more than there are documents."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, offsets = text_bytes(column)
        if lower:
            self.data = UPPER[self.data]
        n = len(self.data)
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = ~SPACE[self.data]
        begins = solid[1:-1] & ~solid[:-2]
        ends = solid[1:-1] & ~solid[2:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        begins[inner] = solid[inner + 1]
        ends[inner - 1] = solid[inner]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.offsets = offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A hash of each word's bytes, wherever they stand. Worked out for about `SLICE_BYTES` at a time."""
        out = np.zeros(len(self.starts), np.uint64)
        begin = 0
        while begin < len(out):
            base = self.starts[begin]
            end = max(begin + 1, int(np.searchsorted(self.ends, base + SLICE_BYTES, "right")))
            data = self.data[base:self.ends[end - 1]]
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_RANDOM[data] * powers(BASE, len(data)), out=sums[1:])
            starts, ends = self.starts[begin:end] - base, self.ends[begin:end] - base
            out[begin:end] = mix((sums[ends] - sums[starts]) * powers(inverse(BASE), len(data) + 1)[starts])
            begin = end
        return out


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values; the caller leaves out those that cross documents."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    base = 0xD6E8FEB86659FD93
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(inverse(base), len(hashes) - n + 1))


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Positions in the concatenated words at which n consecutive words lie in one document."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, np.int64)
    whole = np.ones(total, bool)
    for back in range(1, n):  # the last n - 1 words of each document begin none
        at = first[1:] - back
        whole[at[at >= first[:-1]]] = False
    return np.flatnonzero(whole)
