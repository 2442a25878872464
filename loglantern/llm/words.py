"""Words, word hashes and word windows of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a longest run of bytes other than blank and 0x09 to 0x0D. These six are single bytes in
UTF-8, so no text is decoded. Hashes have 64 bits: a table value per byte, weighed by powers of an
odd number, so that any stretch is the difference of two running sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A block of whole texts is closed when it has so many bytes; a longer text is a block of its own.
#: Hashing takes many times as much memory, part of which a Python worker keeps for as long as its executor lives.
BLOCK_BYTES = 1 << 19

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240901)).integers(0, 2**64, 256, dtype=np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C1B)  # 3 modulo 8: differences of its powers lose few bits
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64. Those for a block are kept, those for a longer text are not."""
    found = _powers
    if len(found[0]) < n:
        room, found = max(n, 1 << 16), []
        for base in (_BASE, _INVERSE):
            row = np.full(room, base, np.uint64)
            row[0] = 1
            found.append(np.cumprod(row, dtype=np.uint64, out=row))
        if room <= BLOCK_BYTES + 1:
            _powers[:] = found
    return found[0][:n], found[1][:n]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64 bit values after which every bit depends on all others."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """A block of texts: their bytes, and the words of all of them in order.

    `first[i]` to `first[i + 1]` are text i's words; word w is data[start[w]:end[w]]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.data = data = _LOWER[data] if lower else data
        self.bounds = bounds
        blank = _SEPARATOR[data]
        cuts = bounds[:-1][(bounds[:-1] > 0) & (bounds[:-1] < len(data))]
        begins, ends = ~blank, ~blank
        begins[1:] &= blank[:-1]
        ends[:-1] &= blank[1:]
        begins[cuts] = ~blank[cuts]
        ends[cuts - 1] = ~blank[cuts - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One hash a word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        power, inverse = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * power[:-1], dtype=np.uint64, out=total[1:])
        return mixed((total[self.end] - total[self.start]) * inverse[self.start])

    def text_of(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self)), self.counts())


def running(hashes: np.ndarray) -> np.ndarray:
    """Sums from which `stretch` reads the hash of any run of words."""
    power, _ = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[:-1], dtype=np.uint64, out=total[1:])
    return total


def stretch(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of the words start to end, which depend on those words and their number alone."""
    _, inverse = powers(len(total))
    return mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each text, and where each text's begin. A text of fewer words has one: all of it."""
    total = running(hashes)
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    bounds = np.concatenate(([0], np.cumsum(n)))
    start = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], n)
    return stretch(total, start, start + np.repeat(np.minimum(count, k), n)), bounds


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its texts; null is as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut batches into blocks of whole texts; each with its rows."""
    for batch in batches:
        data, bounds = string_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
            stop = min(stop, batch.num_rows, at + 4096)
            yield batch.slice(at, stop - at), Texts(data[bounds[at] : bounds[stop]], bounds[at : stop + 1] - bounds[at], lower)
            at = stop


def taken(batch: pa.RecordBatch, name: str, index: np.ndarray) -> pa.Array:
    """Values of a column for row numbers."""
    return batch.column(batch.schema.get_field_index(name)).take(pa.array(index, pa.int64()))


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())
