"""Words of many texts at once, as numpy arrays.

Words are the runs of bytes outside the ASCII white space 0x09-0x0D and 0x20,
after A-Z became a-z. A word is known by a 64-bit hash: every byte stands for
a fixed random number, multiplied by a power of an odd base; sums over prefixes
give all words of a block in a few passes. 64 bits keep chance collisions
negligible below some hundred million distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(20240131).integers(0, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


class Words(NamedTuple):
    """first_row: of the block in its batch. row, hash, start, end: per word. data: lower-cased bytes. total: prefix sums for hashes."""

    first_row: int
    rows: int
    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    total: np.ndarray

    def hashes_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of any stretches of the data; a stretch with the bytes of a word has the word's hash."""
        return mixed((self.total[end] - self.total[start]) * _power_tables(len(self.data))[1][start])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size + 1:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of the texts; a null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Words]:
    """The words of ``texts`` in blocks of whole texts of about ``block_bytes``."""
    if len(texts) == 0:
        return
    data, offsets = _utf8(texts)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield _words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first)
        first = last


def _words(raw: np.ndarray, offsets: np.ndarray, first_row: int) -> Words:
    rows, size = len(offsets) - 1, len(raw)
    data = _LOWER[raw]
    inside = np.zeros(size + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < size)]
    opens[cuts] = inside[1:-1][cuts]
    closes[cuts - 1] = inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power = _power_tables(max(size, BLOCK_BYTES))[0]
    total = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * power[:size], out=total[1:])
    row = np.repeat(np.arange(rows), np.diff(np.searchsorted(start, offsets)))
    words = Words(first_row, rows, row, np.zeros(0, np.uint64), start, end, data, total)
    return words._replace(hash=words.hashes_of(start, end))


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, by row and hash.

    A row with fewer words than ``width`` has its whole sequence as its only
    shingle; one without words has none.
    """
    count = np.bincount(words.row, minlength=words.rows)
    begin = np.concatenate(([0], np.cumsum(count)))
    hashes = np.zeros(len(words.hash), dtype=np.uint64)
    padded = np.concatenate((words.hash, np.zeros(width - 1, dtype=np.uint64)))
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(width):
        hashes += padded[k : k + len(hashes)] * factors[k]
    left = begin[words.row + 1] - np.arange(len(words.row))
    whole = left >= width
    row, value = words.row[whole], mixed(hashes[whole])
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        lengths = count[short]
        at = np.repeat(begin[short], lengths) + _counters(lengths)
        terms = words.hash[at] * factors[_counters(lengths)]
        sums = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(lengths)[:-1])))
        row = np.concatenate((row, short))
        value = np.concatenate((value, mixed(sums + lengths.astype(np.uint64))))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


def _counters(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for every n of ``lengths``, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
