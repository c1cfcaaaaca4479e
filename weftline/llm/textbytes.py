"""Vectorised work on the UTF-8 bytes of whole text columns.

The Python stages of this subpackage get their texts as Arrow batches.  They do
not loop over words: a batch is cut into slices of a few megabytes, and numpy
finds the words of a whole slice at once, hashes them with prefix sums and
combines them into shingles.  A single text longer than a slice is one slice by
itself, so texts are always processed whole.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a few 8-byte temporaries per byte are alive.
SLICE_BYTES = 1 << 18

# the system's allocator gives large blocks back at once; the default one keeps them in every worker
pa.set_memory_pool(pa.system_memory_pool())

_U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply)."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=_U64) * _U64(_ODD))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, _U64)
        self.down = np.ones(1, _U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            self.up, self.down = self._run(_BASE, size), self._run(_BASE_INV, size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        out = np.empty(n, _U64)
        out[0] = 1
        done, step = 1, base
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * _U64(step)
            done += more
            step = step * step & _MASK
        return out


_POWERS = _Powers()


def lean(run: Callable) -> Callable:
    """A batch function after which the worker, which Spark keeps for other tasks, holds no memory of its own."""

    @functools.wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return out


def release() -> None:
    """Gives memory that is free back to the system."""
    _POWERS.__init__()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library



@dataclass
class TextSlice:
    """Some consecutive rows of a text column."""

    first: int  # of the rows in the batch
    data: np.ndarray  # uint8, a private copy
    offsets: np.ndarray  # int64, one more than there are rows
    valid: np.ndarray  # bool per row, False for null

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, slice_bytes: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """The rows of a string column in slices of about `slice_bytes`; nulls are empty and marked."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return
    valid = np.ones(len(column), bool) if not column.null_count else np.asarray(column.is_valid())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + slice_bytes, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield TextSlice(at, data[offsets[at] : offsets[to]].copy(), offsets[at : to + 1] - offsets[at], valid[at:to])
        at = to


def lower_ascii(data: np.ndarray) -> None:
    """A-Z to a-z, in place; other characters stay."""
    data[(data >= 65) & (data <= 90)] += 32


@dataclass
class Words:
    starts: np.ndarray  # byte positions in the slice
    ends: np.ndarray
    row_offsets: np.ndarray  # int64: words of row r are row_offsets[r]:row_offsets[r + 1]


def find_words(part: TextSlice, word_byte: np.ndarray) -> Words:
    """Maximal runs of bytes for which the table `word_byte` (256 booleans) holds, never across rows."""
    inside = word_byte[part.data]
    n = len(inside)
    if not n:
        return Words(np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(part.rows + 1, np.int64))
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = part.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] |= inside[edges]
    stops[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, part.offsets).astype(np.int64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes give equal hashes wherever they stand."""
    n = len(data)
    up, down = _POWERS.get(n + 1)
    sums = np.empty(n + 1, _U64)
    sums[0] = 0
    np.cumsum(_BYTE_CODE[data] * up[:n], out=sums[1:])
    out = (sums[ends] - sums[starts]) * down[starts]
    return mix64(out + (ends - starts).astype(_U64) * _U64(_ODD))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` consecutive word hashes; runs across rows must be masked by the caller."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, _U64)
    out = np.full(n, size, _U64)
    for k in range(size):
        out = out * _U64(_BASE) + words[k : k + n]
    return mix64(out)


#: Word bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on text with A-Z lower-cased.
WORD_CHARS = np.zeros(256, bool)
WORD_CHARS[0x30:0x3A] = WORD_CHARS[0x61:0x7B] = WORD_CHARS[0x80:] = True


def shingle_sets(part: TextSlice, size: int, word_byte: np.ndarray = NOT_SPACE) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its `size`-word shingles.

    A row of fewer words has its whole word sequence as the only shingle; a row without words has none.
    """
    lower_ascii(part.data)
    found = find_words(part, word_byte)
    words = span_hashes(part.data, found.starts, found.ends)
    runs = window_hashes(words, size)
    bounds = found.row_offsets.tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            own = np.sort(runs[a : b - size + 1])
            new = own[1:] != own[:-1]
            yield own if new.all() else np.concatenate([own[:1], own[1:][new]])
        elif b > a:
            yield window_hashes(words[a:b], b - a)
        else:
            yield np.empty(0, _U64)
