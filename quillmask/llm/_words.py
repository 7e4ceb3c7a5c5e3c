"""Words of whole batches of texts as arrays: hashes, numbers and bytes without an object for each word.

A word is a run of bytes other than ASCII white space (`[^\\x20\\x09-\\x0D]+`), A-Z lower-cased. Each text is followed by a mark, the
one-byte word MARK, which no text in UTF-8 holds, so it ends the text and stands for the end token where one is wanted.
Hashes have 64 bits: a sum of random numbers of bytes by powers of an odd number, mixed. Memory is linear in a batch, whose bytes ship() bounds.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = b"\xff"
BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
SMALL = np.arange(256, dtype=np.uint8) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0).astype(np.uint8)
_BYTES = np.random.default_rng(29).integers(1, 1 << 63, 256).astype(np.uint64)[SMALL]
_ODD = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes hashed at a time, so that what is made of them stays in the cache; blocks end between words.
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the odd number, and of its inverse."""
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 64))))


class Words(NamedTuple):
    data: np.ndarray  # bytes of the texts, a blank before, and a mark after each
    start: np.ndarray  # of each word, its first byte, and the one after its last
    stop: np.ndarray
    hash: np.ndarray
    marks: np.ndarray  # of each text, which word its mark is

    def starts(self) -> np.ndarray:
        """Of each text, its first word, which may be its mark."""
        return np.r_[0, self.marks[:-1] + 1]

    def bytes_of(self, at: np.ndarray) -> pa.Array:
        """These words, lower-cased, as a binary array."""
        start, size = self.start[at], self.stop[at] - self.start[at]
        ends = np.cumsum(size)
        source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(SMALL[self.data[source]])])


def words_of(texts: pa.Array) -> Words:
    """texts: strings or binaries, no nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    parts = pa.concat_arrays([pa.array([b""], pa.binary()), texts.cast(pa.binary()), pa.array([b""], pa.binary())])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts), b" " + MARK + b" ")
    data = np.frombuffer(joined[0].as_buffer(), np.uint8)[2:]  # no mark before the first text
    blank = BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, stop = edges[::2], edges[1::2]
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        to = max(at + 1, int(np.searchsorted(stop, low + BLOCK)))
        size = int(stop[to - 1]) - low
        forth, back = _powers(max(BLOCK, 1 << (size - 1).bit_length()))
        sums = np.empty(size + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTES[data[low : low + size]] * forth[:size], out=sums[1:])
        out[at:to] = mix((sums[stop[at:to] - low] - sums[start[at:to] - low]) * back[start[at:to] - low])
        at = to
    marks = np.flatnonzero((stop - start == 1) & (data[start] == MARK[0]))
    return Words(data, start, stop, out, marks)


@lru_cache(maxsize=1)
def mark_hash() -> np.uint64:
    return words_of(pa.array([b""], pa.binary())).hash[0]


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct hash stands first or elsewhere, by ascending hash; of each hash its number among them."""
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(hashes)
    new = np.r_[True, np.diff(hashes[order]) != 0]
    number = np.empty(len(hashes), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number
