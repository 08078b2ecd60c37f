"""Vectorised tokenising and hashing of Arrow text batches inside Spark tasks.

Everything here works on the raw UTF-8 buffer of an Arrow string column, so a task touches each byte a fixed number of
times with numpy and never builds a Python object per word. Batches are cut into slices of about ``SLICE_BYTES`` (a
longer document is a slice of its own), which bounds the memory of a task by its longest document.

Nulls count as empty texts. A word's hash is the 64-bit sum of random table entries, one for every (place, byte), so no
pair of words is built to collide; words longer than the table use xxh3. A run of words is a sum with random odd factors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 18
_ALL = np.arange(256)
#: Words of the corpus contracts: runs of anything but ASCII white space.
NON_SPACE = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: Words of benchmark matching: runs of digits, lower-case ASCII letters and non-ASCII characters.
ALPHANUMERIC = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
ASCII_LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)
_RNG = np.random.default_rng(20240607)
#: Words up to this length are hashed by table.
PLACES = 32
_TABLE = _RNG.integers(0, 2**64, PLACES * 256, dtype=np.uint64)
_FACTORS = _RNG.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads sums over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row count, bytes, row offsets into them) of consecutive slices of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end - row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of a slice: byte starts and ends, 64-bit hashes and each row's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, members: np.ndarray, lower: bool):
        if lower:
            data = ASCII_LOWER[data]
        self.data, n = data, len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = members[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.starts = self.starts[self.starts < n]
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.rows = np.searchsorted(self.starts, offsets)
        self.hashes = self._hashes(np.flatnonzero(inside[1:-1]))

    def _hashes(self, at: np.ndarray) -> np.ndarray:
        """``at``: the places of all bytes of words."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        place = np.minimum(at - np.repeat(self.starts, lengths), PLACES - 1)
        sums = np.add.reduceat(_TABLE[(place << 8) + self.data[at]], np.cumsum(lengths) - lengths)
        out = mix(sums + lengths.astype(np.uint64) * _FACTORS[0])
        for k in np.flatnonzero(lengths > PLACES):
            out[k] = xxhash.xxh3_64_intdigest(self.data[self.starts[k] : self.ends[k]].tobytes())
        return out

    def __len__(self) -> int:
        return len(self.starts)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def gram_hashes(words: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` (16 at most) words from each ``start``."""
    out = np.full(len(start), size, np.uint64)
    for j in range(size):
        out += words[start + j] * _FACTORS[j]
    return mix(out)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, row borders ignored."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, np.uint64)
    for j in range(size if n else 0):
        out += words[j : j + n] * _FACTORS[j]
    return mix(out)


def byte_words(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each position as one number, zeros behind the end; ``order`` as in a numpy dtype."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    out = np.empty(n, np.uint64)
    for j in range(min(8, n)):
        m = (n - j + 7) // 8
        out[j::8] = padded[j : j + 8 * m].view(order + "u8")
    return out


def byte_grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` bytes, a multiple of eight, row borders ignored."""
    n = max(0, len(data) - size + 1)
    words, out = byte_words(data), np.zeros(n, np.uint64)
    for j in range(0, size if n else 0, 8):
        out += words[j : j + n] * _FACTORS[j // 8]
    out ^= out >> np.uint64(32)
    out *= _FACTORS[8]
    return out


def content_hashes(items: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """xxh3 of the items of each half-open span."""
    view, width = memoryview(np.ascontiguousarray(items)).cast("B"), items.itemsize
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a:b]) for a, b in zip((start * width).tolist(), (stop * width).tolist(), strict=True)), np.uint64, len(start))


def sliding_min_at(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum, by the high 40 bits, of every ``width`` consecutive values."""
    n = max(0, len(values) - width + 1)
    out = np.zeros(n, np.int64)
    room = np.uint64((1 << 24) - 1)  # the low 24 bits hold the index inside a block
    for low in range(0, n, 1 << 23):
        part = values[low : low + (1 << 23) + width - 1]
        best, span, m = (part & ~room) | np.arange(len(part), dtype=np.uint64), 1, len(part) - width + 1
        while span * 2 <= width:
            best, span = np.minimum(best[:-span], best[span:]), span * 2
        best = np.minimum(best[:m], best[width - span : width - span + m])
        out[low : low + m] = (best & room).astype(np.int64) + low
    return out


def starts_within(rows: np.ndarray, width: int) -> np.ndarray:
    """Positions at which ``width`` consecutive items lie in one row; ``rows`` holds the row offsets of the items."""
    total = int(rows[-1])
    ok = np.zeros(total + 1, np.int32)
    lengths = np.diff(rows)
    long = lengths >= width
    np.add.at(ok, rows[:-1][long], 1)
    np.add.at(ok, (rows[1:] - width + 1)[long], -1)
    return np.flatnonzero(np.cumsum(ok)[:-1])


def cover(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Mask of the items inside any half-open span."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
