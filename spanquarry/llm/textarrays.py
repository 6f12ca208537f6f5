"""Vectorised tokenising and hashing of whole texts, on the bytes of Arrow string columns.

Every step is a NumPy pass over the bytes or words of a slice of rows, so no Python object is made for
a word. Slices hold about ``SLICE_BYTES`` of text, or one longer text, which bounds a worker's memory.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LANES = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) | 1 for i in range(16)], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}
PRIME = (1 << 31) - 1
_SMALL = 1_234_567_891


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(int(n - 1).bit_length(), 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            grown = np.full(size, base, dtype=np.uint64)
            grown[0] = 1
            _powers[name] = np.cumprod(grown, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all 64 bits depend on all bits of ``x``."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def factors(n: int) -> np.ndarray:
    """At least ``n`` random odd numbers, one for each place of a word."""
    if len(_powers.get("factors", ())) < n:
        size = 1 << max(int(n - 1).bit_length(), 12)
        _powers["factors"] = mix(np.arange(1, size + 1, dtype=np.uint64) * U(_BASE)) | U(1)
    return _powers["factors"]


def small_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of a number and of its inverse, modulo the prime ``PRIME``."""
    if len(_powers.get("small-up", ())) < n:
        size = 1 << max(int(n - 1).bit_length(), 20)
        for name, base in (("small-up", _SMALL), ("small-down", pow(_SMALL, -1, PRIME))):
            grown = np.ones(size, dtype=np.uint64)
            reach = 1
            while reach < size:
                grown[reach : 2 * reach] = grown[:reach] * U(pow(base, reach, PRIME)) % U(PRIME)
                reach *= 2
            _powers[name] = grown
    return _powers["small-up"], _powers["small-down"]


def lut(is_separator) -> np.ndarray:
    """A 256-entry table: whether a byte belongs to a word."""
    return np.array([not is_separator(b) for b in range(256)])


#: Words are runs of bytes other than ASCII white space.
SPACED = lut(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes: (first row, end row, bytes, offsets from 0)."""
    data, offsets = raw(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    release()


def release() -> None:
    """Gives what a worker has freed back to the system: workers outlive their tasks and stand beside the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Words:
    """The words of a slice: ``start`` and ``end`` byte positions, ``first`` (word offsets by row), ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED, lower: bool = True):
        n = len(data)
        self.data = _LOWER[data] if lower else data
        inside = table[data]
        fresh = np.zeros(n + 1, dtype=bool)
        fresh[offsets] = True
        begins, stops = inside.copy(), inside.copy()
        if n > 1:
            begins[1:] &= ~inside[:-1] | fresh[1:n]
            stops[:-1] &= ~inside[1:] | fresh[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hash(inside)

    def _hash(self, inside: np.ndarray) -> np.ndarray:
        """A sum over each word's bytes, each times a random number of its place in the word.

        Unlike a polynomial modulo 2**64, such a sum has no inputs that are known to collide for any base.
        """
        sizes = self.end - self.start
        if not len(sizes):
            return np.empty(0, dtype=np.uint64)
        first = np.cumsum(sizes) - sizes
        place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
        terms = (self.data[inside].astype(np.uint64) + U(1)) * factors(int(sizes.max()))[place]
        return mix(np.add.reduceat(terms, first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words and their offsets by row.

        A row of fewer words has one shingle, its whole sequence; a row without words has none.
        """
        counts = self.counts()
        total = len(self.hash)
        sums = np.zeros(max(total - width + 1, 0), dtype=np.uint64)
        for lane in range(width):
            sums += self.hash[lane : lane + len(sums)] * _LANES[lane]
        row = np.repeat(np.arange(len(counts)), counts)
        whole = np.arange(len(sums)) + width <= self.first[1:][row[: len(sums)]]
        out_counts = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
        first = np.zeros(len(counts) + 1, dtype=np.int64)
        np.cumsum(out_counts, out=first[1:])
        out = np.empty(first[-1], dtype=np.uint64)
        long = np.repeat(counts >= width, out_counts)
        out[long] = mix(sums[whole])
        for r in np.flatnonzero((counts > 0) & (counts < width)):
            own = self.hash[self.first[r] : self.first[r + 1]]
            out[first[r]] = mix(np.array([(own * _LANES[: len(own)]).sum(dtype=np.uint64) ^ U(len(own))]))[0]
        return out, first
