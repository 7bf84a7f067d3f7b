"""Words of whole texts as numpy arrays, and hashes of words and word runs.

A batch is worked on in chunks of about a megabyte of text, so memory follows
the chunk and not the batch; only a single longer text makes a chunk larger.
Hashes are 64-bit: a polynomial over bytes (or over word hashes) modulo 2**64,
finished by a bit mixer. They are the same on every machine and in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64

#: Bytes of words in ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_BYTE_BASE, _BYTE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_WORD_BASE, _WORD_INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = np.asarray(x, dtype=U).copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, dtype=U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * CHUNK:
            _POWERS[base] = have
    return have[:n]


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U))
_FOLDED_VALUES = _BYTE_VALUES.copy()
_FOLDED_VALUES[65:91] = _BYTE_VALUES[97:123]


@dataclass
class Chunk:
    """Some rows of a batch: their texts' bytes, one after another."""

    rows: range
    data: np.ndarray  # uint8
    offsets: np.ndarray  # of each text in data, and the end


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Cut a string column into chunks of about ``size`` bytes. A null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        own = offsets[first : last + 1]
        yield Chunk(range(first, last), data[own[0] : own[-1]], own - own[0])
        first = last


@dataclass
class Words:
    """Words of a chunk: where each starts and stops, and the first word of each row (and the end)."""

    starts: np.ndarray
    stops: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find_words(chunk: Chunk, is_word: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of bytes that ``is_word`` marks; a run ends with its text."""
    inside = is_word[chunk.data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = chunk.offsets
    full = at[:-1] < at[1:]
    begins[at[:-1][full]] = inside[at[:-1][full]]
    ends[at[1:][full] - 1] = inside[at[1:][full] - 1]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at))


def _spans(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int, inverse: int) -> np.ndarray:
    """Hashes of values[start:stop]; spans may overlap. Worked off in pieces, so memory stays small."""
    out = np.empty(len(starts), dtype=U)
    first = 0
    while first < len(starts):
        low = int(starts[first])
        last = max(first + 1, int(np.searchsorted(starts, low + CHUNK, side="left")))
        high = int(stops[first:last].max())
        total = np.zeros(high - low + 1, dtype=U)
        np.cumsum(values[low:high] * powers(base, high - low), out=total[1:])
        begin, end = starts[first:last] - low, stops[first:last] - low
        out[first:last] = (total[end] - total[begin]) * powers(inverse, high - low + 1)[begin]
        first = last
    return mix(out ^ mix((stops - starts).astype(U)))


def hash_words(chunk: Chunk, words: Words, fold_case: bool = False) -> np.ndarray:
    """A hash of each word's bytes; with ``fold_case``, A-Z count as a-z."""
    values = (_FOLDED_VALUES if fold_case else _BYTE_VALUES)[chunk.data]
    return _spans(values, words.starts, words.stops, _BYTE_BASE, _BYTE_INVERSE)


def hash_runs(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each run of words hashes[start:stop]; starts ascend."""
    return _spans(hashes, starts, stops, _WORD_BASE, _WORD_INVERSE)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    low, size = values, 1
    while size * 2 <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def signed(x: np.ndarray) -> pa.Array:
    """As Spark's long."""
    return pa.array(np.ascontiguousarray(x, dtype=U).view(np.int64))


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """One list per row of the next ``counts`` values."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)
