"""Words, hashes and rolling windows of a batch of texts, for use inside Arrow tasks."""
from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text handled at a time inside a task; a longer single text is handled alone.
SLICE_BYTES = 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Cut batches where their texts would pass ``limit`` bytes; no row is split."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(ends):
            spent = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(ends, spent + limit, "right")), first + 1)
            yield table.slice(first, last - first)
            first = last


def trim() -> None:
    """Give free memory back to the system: workers outlive tasks, and what one operator
    grew would stay while the next one runs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(work):
    """The same generator of batches, with ``trim`` at its end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            del batches
            trim()
    return run


def one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One contiguous array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array(
                [], column.type)
    return column


@dataclass
class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text. Text ``i`` has the words
    ``offsets[i]:offsets[i+1]`` of ``codes``, which point into ``vocabulary``."""

    offsets: np.ndarray
    codes: np.ndarray
    vocabulary: pa.Array
    flat: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self) -> np.ndarray:
        """The text each word stands in."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every task."""
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocabulary.to_pylist()),
                          np.uint64, len(self.vocabulary))
        return own[self.codes] if len(own) else np.zeros(0, np.uint64)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sum a value per word over each text."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def words(texts: pa.Array) -> Words:
    """Split texts; null and empty texts have no words."""
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(one(texts).cast(pa.string()), ""))
    lists = pc.ascii_split_whitespace(trimmed)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    counts[pc.equal(trimmed, "").to_numpy(zero_copy_only=False)] = 0
    flat = one(lists.flatten())
    if len(flat) != counts.sum():
        flat = flat.filter(pc.not_equal(flat, ""))
    coded = pc.dictionary_encode(flat)
    return Words(np.concatenate([[0], np.cumsum(counts)]),
                 coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, flat)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of the ``n`` words from each position, modulo 2**64; positions
    whose window would pass the end of the array are left out."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= BASE
        out += hashes[j:j + m]
    return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a hash over all others (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def whole(offsets: np.ndarray, n: int) -> np.ndarray:
    """Positions from which ``n`` words stay inside one text."""
    counts = np.diff(offsets)
    ends = np.repeat(offsets[1:], counts)
    return np.flatnonzero(np.arange(offsets[-1]) + n <= ends)


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window of ``n`` words from one of ``starts``."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    ordered = np.sort(keys)
    found = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = np.zeros(len(keys), bool)
    if len(found):
        shift = np.uint64(44)  # a table of 2**20 leading bits spares most keys the search
        table = np.zeros(1 << 20, bool)
        table[found >> shift] = True
        near = np.flatnonzero(table[keys >> shift])
        at = np.minimum(np.searchsorted(found, keys[near]), len(found) - 1)
        out[near] = found[at] == keys[near]
    return out


class Runs:
    """A growing array of runs of different lengths."""

    def __init__(self, kind=np.int64):
        self._flat, self._begin = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64)
        self._used = self._n = 0

    def __len__(self) -> int:
        return self._n

    @property
    def flat(self) -> np.ndarray:
        return self._flat[:self._used]

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        while self._used + len(values) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while self._n + len(sizes) + 1 > len(self._begin):
            self._begin = np.concatenate([self._begin, np.zeros_like(self._begin)])
        self._flat[self._used:self._used + len(values)] = values
        self._begin[self._n + 1:self._n + 1 + len(sizes)] = self._used + np.cumsum(sizes)
        self._used += len(values)
        self._n += len(sizes)

    def take(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs one after another, and their lengths."""
        begin = self._begin[runs]
        sizes = self._begin[runs + 1] - begin
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)
        return self._flat[at], sizes
