"""Vectorised word work on Arrow batches of texts: positions and hashes of words, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of 0 to 8 bytes
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... mod 2**64."""
    found = _powers.get(int(base))
    if found is None or len(found) < n:
        with np.errstate(over="ignore"):
            found = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 20), base)]))
        _powers[int(base)] = found
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """Words of a batch: bytes `starts[i]:ends[i]` of `data`; document d has words `first[d]:first[d + 1]`."""

    def __init__(self, texts: pa.Array, lower: bool = False, separators: np.ndarray = SPACE):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        self.offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8)[self.offsets[0] : self.offsets[-1]] if whole else np.zeros(0, np.uint8)
        self.offsets = self.offsets - self.offsets[0]
        self.data = LOWER[data] if lower else data
        ink = np.zeros(len(data) + 2, bool)
        ink[1:-1] = ~separators[data]
        cut = np.zeros(len(data) + 1, bool)  # a document starts here
        cut[self.offsets] = True
        self.starts = np.flatnonzero(ink[1:] & (~ink[:-1] | cut))
        self.ends = np.flatnonzero(ink[:-1] & (~ink[1:] | cut))
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self, which: np.ndarray | slice = slice(None), ends: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes; of the words `which` up to `ends`, if these are given.

        Eight bytes at a time are scrambled with their place in the word, and summed: no linear structure is left in
        which regular words could cancel out."""
        starts = self.starts[which]
        size = (self.ends[which] if ends is None else ends) - starts
        if not len(starts):
            return np.zeros(0, np.uint64)
        many = np.maximum(-(-size // 8), 1)
        last = np.cumsum(many)
        nth = np.arange(last[-1]) - np.repeat(last - many, many)
        at = np.repeat(starts, many) + 8 * nth
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))[at]
        eights &= _FIRST_BYTES[np.clip(np.repeat(size, many) - 8 * nth, 0, 8)]
        with np.errstate(over="ignore"):
            found = mix(eights ^ mix(_BASE * (nth.astype(np.uint64) + np.uint64(1))))
            return mix(np.add.reduceat(found, last - many) + size.astype(np.uint64) * _LENGTH)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words within a document, and each document's first shingle.

    A document of fewer words has one shingle of all its words; one without words has none."""
    counts = np.diff(first)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * _power(_BASE, len(hashes)), out=sums[1:])
        many = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
        begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        end = begin + np.repeat(np.minimum(counts, width), many)
        found = mix((sums[end] - sums[begin]) * _power(_INVERSE, len(hashes) + 1)[begin])
    return found, np.concatenate([[0], np.cumsum(many)])
