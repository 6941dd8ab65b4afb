"""Words of Arrow text columns as numpy arrays, without a Python object for each word.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. Hashes are 64-bit polynomials over the word's bytes with random byte
weights; two seeds give 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 20
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: All ASCII but letters and digits, for matches that ignore punctuation.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


@cache
def byte_weights(seed: int, lower: bool) -> np.ndarray:
    w = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)
    if lower:
        w[65:91] = w[97:123]
    return w


BASE = U(0x5851F42D4C957F2D)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES), base, dtype=U)
        have[0] = 1
        have = np.cumprod(have, dtype=U)
        if n <= 4 * BLOCK_BYTES:
            _powers[int(base)] = have
    return have


@dataclass
class Words:
    """Words of some consecutive documents: byte ranges, and the range of words of each document."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  #: word offsets, one more than documents
    separator: np.ndarray  #: by byte

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, seed: int = 1, lower: bool = False) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, U)
        weights = np.where(self.separator, U(0), byte_weights(seed, lower))
        out, a = np.empty(len(self.starts), U), 0
        while a < len(out):  # some 40 bytes are held for each byte: words of ``BLOCK_BYTES`` at a time, a longer word alone
            at = self.starts[a]
            z = max(a + 1, int(np.searchsorted(self.ends, at + BLOCK_BYTES, "right")))
            n, here = int(self.ends[z - 1] - at), self.starts[a:z] - at
            terms = weights[self.data[at : at + n]] * powers(BASE, n)[:n]
            out[a:z] = mix(np.add.reduceat(terms, here) * powers(BASE_INVERSE, n)[here])
            a = z
        return out

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def strings(column) -> pa.Array:
    """A contiguous large_string array; nulls become the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets, from 0 on."""
    n, at = len(array), array.offset
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, at * 8) if n else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[off[0] : off[-1]], off - off[0]


def find_words(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SEPARATOR) -> Words:
    inside = ~separator[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = off[:-1][np.diff(off) > 0]
    begins[full] |= inside[full]
    last = off[1:][np.diff(off) > 0] - 1
    ends[last] |= inside[last]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off), separator)


def blocks(column, separator: np.ndarray = SEPARATOR, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    data, off = raw(strings(column))
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, find_words(data[off[a] : off[b]], off[a : b + 1] - off[a], separator)
        a = b


def grams(h: np.ndarray, first: np.ndarray, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one document, and the index of each run's first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    out = h[:m] + U(salt)
    for j in range(1, n):
        out = out * U(0x9E3779B97F4A7C15) + h[j : j + m]
    ok = np.ones(m, bool)
    for j in range(1, n):  # a run must not pass the end of its document
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < m)]] = False
    at = np.flatnonzero(ok)
    return mix(out[at]), at


class IdTable:
    """Lists of ids by 128-bit keys, in open addressing over numpy arrays; at most ``keep`` lists, some 40 bytes each."""

    def __init__(self, keep: int, kind: str = "<u2"):
        self.keep, self.n = keep, 0
        self.mask = (1 << (3 * keep // 2 - 1).bit_length()) - 1
        self.one, self.two = np.zeros(self.mask + 1, U), np.zeros(self.mask + 1, U)
        self.entry = np.full(self.mask + 1, -1, np.int32)
        self.offset = np.zeros(1, np.int64)
        self.ids = np.zeros(0, kind)
        self.used = 0

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 for keys that aren't there."""
        out = np.full(len(one), -1, np.int64)
        at, open_ = (one & U(self.mask)).astype(np.int64), np.arange(len(one))
        while len(open_):
            e = self.entry[at]
            same = (self.one[at] == one[open_]) & (self.two[at] == two[open_]) & (e >= 0)
            out[open_[same]] = e[same]
            on = ~same & (e >= 0)
            open_, at = open_[on], (at[on] + 1) & self.mask
        return out

    def add(self, one: np.ndarray, two: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        """Adds distinct new keys with their lists, one after the other in ``ids``, as many as there is room for."""
        n = min(len(one), self.keep - self.n)
        if n <= 0:
            return
        one, two, lens = one[:n], two[:n], lens[:n]
        total = int(lens.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(total, len(self.ids) // 2 + 4096), self.ids.dtype)])
        self.ids[self.used : self.used + total] = ids[:total]
        if self.n + n + 1 > len(self.offset):
            self.offset = np.concatenate([self.offset[: self.n + 1], np.zeros(max(n, len(self.offset) // 2 + 4096), np.int64)])
        self.offset[self.n + 1 : self.n + n + 1] = self.used + np.cumsum(lens)
        entry = np.arange(self.n, self.n + n)
        self.used, self.n = self.used + total, self.n + n
        at, open_ = (one & U(self.mask)).astype(np.int64), np.arange(n)
        while len(open_):
            free = np.flatnonzero(self.entry[at] < 0)
            _, first = np.unique(at[free], return_index=True)  # one key for each free slot
            won = free[first]
            self.one[at[won]], self.two[at[won]], self.entry[at[won]] = one[open_[won]], two[open_[won]], entry[open_[won]]
            on = np.ones(len(open_), bool)
            on[won] = False
            open_, at = open_[on], (at[on] + 1) & self.mask

    def lists(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the entries' lists, and the lists one after the other."""
        start = self.offset[entry]
        lens = self.offset[entry + 1] - start
        ends = np.cumsum(lens)
        if not len(entry) or not ends[-1]:
            return lens, np.zeros(0, self.ids.dtype)
        return lens, self.ids[np.arange(ends[-1]) + np.repeat(start - (ends - lens), lens)]
