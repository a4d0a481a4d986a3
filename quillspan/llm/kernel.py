"""Vectorised text kernels on Arrow string columns: words, hashes, shingles.

All work is done on the UTF-8 bytes of many documents at once, so that the cost
per word is a few array operations and no Python object is made for it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; documents are never split. Tables of powers just fit it.
CHUNK = (1 << 18) - 2
U64 = np.uint64
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives memory that is free back to the system: workers live on after a task, beside those of the next."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@cache
def _bytes_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.ones(size, U64)
            filled = 1
            while filled < size:
                p[filled : 2 * filled] = p[:filled] * U64(pow(b, filled, 1 << 64))
                filled *= 2
            out.append(p)
        have = _POWERS[base] = (out[0], out[1])
    return have


BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def prefix_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """What ``span_hashes`` needs of ``values``; it serves any number of sets of spans."""
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(BASES[which], len(values) + 1)[0][: len(values)], out=sums[1:])
    return sums


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, sums: np.ndarray | None = None) -> np.ndarray:
    """A hash of values[start:end] for each span, by one prefix sum; equal spans hash alike."""
    if sums is None:
        sums = prefix_sums(values, which)
    down = powers(BASES[which], len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


@dataclass
class Words:
    """The words of the documents lo..hi of a batch; word i lies at data[start[i]:end[i]]."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # the words of document d are first[d]:first[d + 1], d from 0
    bounds: np.ndarray  # its bytes are data[bounds[d]:bounds[d + 1]]

    def hashes(self, which: int = 0) -> np.ndarray:
        return span_hashes(_bytes_table(which + 1)[self.data], self.start, self.end, which)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def chunks(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes, or of one longer document."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def words(column: pa.Array, lower: bool = False, limit: int = CHUNK, space: np.ndarray = SPACE) -> Iterator[Words]:
    """The maximal runs of bytes outside ``space``, chunk by chunk."""
    data, at = text_buffers(column)
    for lo, hi in chunks(at, limit):
        base = int(at[lo])
        own = data[base : int(at[hi])]
        if lower:
            own = LOWER[own]
        bounds = at[lo : hi + 1] - base
        word = ~space[own]
        before = np.zeros(len(own) + 1, bool)
        before[1:] = word
        before[bounds] = False  # a document's first byte follows no word
        after = np.zeros(len(own) + 1, bool)
        after[:-1] = word
        after[bounds] = False
        start = np.flatnonzero(word & ~before[:-1])
        end = np.flatnonzero(word & ~after[1:]) + 1
        yield Words(lo, hi, own, start, end, np.searchsorted(start, bounds), bounds)
    release()


def shingle_hashes(w: Words, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's runs of k words, and where each document's begin.

    A document of fewer words, but not none, has its whole sequence as one.
    """
    own = w.hashes(which)
    first = w.first
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    start = first[:-1][doc] + (np.arange(at[-1]) - at[:-1][doc])
    end = np.minimum(start + k, first[1:][doc])
    return span_hashes(own, start, end, which), at


#: Separators of words made of ASCII letters, digits and all that is not ASCII.
PUNCT = np.zeros(256, bool)
PUNCT[:128] = True
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    PUNCT[_a:_b] = False


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One position of each distinct value, the values ascending, and for each value the index of its own."""
    order = np.argsort(values)
    ascending = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    inverse = np.empty(len(values), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def char_grams(w: Words, which: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size n: the hashes of the n-character pieces of the words ``which``, and the index into ``which`` of each.

    A piece at a word's start or end is told apart from one inside it.
    """
    lead = (w.data & 0xC0) != 0x80
    chars = np.append(np.flatnonzero(lead), len(w.data))
    nth = np.cumsum(lead) - 1  # the character that a byte belongs to
    a, z = nth[w.start[which]], nth[w.end[which] - 1] + 1
    base = BASES[0]
    up, down = powers(base, len(w.data) + 1)
    sums = np.zeros(len(w.data) + 1, U64)
    np.cumsum(_bytes_table(9)[w.data] * up[: len(w.data)], out=sums[1:])
    for n in sizes:
        count = np.maximum(z - a - n + 1, 0)
        of = np.repeat(np.arange(len(which)), count)
        begin = np.concatenate([[0], np.cumsum(count)])
        i = a[of] + (np.arange(begin[-1]) - begin[:-1][of])
        s, e = chars[i], chars[i + n]
        mark = (i == a[of]).astype(U64) * U64(0x632BE59BD9B4E019) + (i + n == z[of]).astype(U64) * U64(0x8CB92BA72F3D8DD7)
        yield n, mix((sums[e] - sums[s]) * down[s] + mark + U64(n)), of
