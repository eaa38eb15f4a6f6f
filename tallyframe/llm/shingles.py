"""Distinct word shingles of texts as 64-bit hashes, computed on whole byte arrays.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. A
word's hash is a polynomial in random values of its bytes, taken from running
sums, so no word becomes a Python object. Memory beyond the text of a batch is
eight bytes a word plus work arrays of a block of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tallyframe.llm.arrays import runs

WIDTH = 5
BLOCK = 1 << 18

_random = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_FACTORS = _random.integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _random.integers(1, 2**63, WIDTH, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < size:
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(_BASE, -1, 1 << 64))
            up = np.cumprod(np.full(size, np.uint64(_BASE)), dtype=np.uint64)
            down = np.cumprod(np.full(size, inverse), dtype=np.uint64)
        _powers[:] = [up, down]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block and the number of words in each of its rows."""
    size = len(raw)
    if not size:
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    up, down = _tables(max(size, BLOCK))
    solid = ~_SPACE[raw]
    first = np.empty(size, dtype=bool)
    first[0] = True
    np.logical_not(solid[:-1], out=first[1:])
    breaks = offsets[1:-1]
    first[breaks[breaks < size]] = True
    starts = np.flatnonzero(first & solid)
    last = np.empty(size, dtype=bool)
    last[-1] = True
    np.logical_not(solid[1:], out=last[:-1])
    last[breaks[(breaks > 0) & (breaks <= size)] - 1] = True
    ends = np.flatnonzero(last & solid)
    with np.errstate(over="ignore"):
        total = np.cumsum(_VALUES[raw] * up[:size], dtype=np.uint64)
        before = np.where(starts > 0, total[starts - 1], np.uint64(0))
        words = mix((total[ends] - before) * down[starts] * np.uint64(_BASE))
    return words, np.diff(np.searchsorted(starts, offsets))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row, word hashes, words per row)`` for runs of rows."""
    for a, b in runs(offsets, block):
        low, high = int(offsets[a]), int(offsets[b])
        if high - low <= 2 * block:
            words, counts = _block_words(raw[low:high], offsets[a : b + 1] - low)
            yield a, b, words, counts
            continue
        parts = []
        while low < high:  # one long row: cut it at white space
            cut = min(low + block, high)
            while cut < high:
                gaps = np.flatnonzero(_SPACE[raw[cut : cut + block]])
                cut = cut + int(gaps[0]) if len(gaps) else min(cut + block, high)
                if len(gaps):
                    break
            parts.append(_block_words(raw[low:cut], np.array([0, cut - low]))[0])
            low = cut
        words = np.concatenate(parts)
        yield a, b, words, np.array([len(words)])


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, ascending distinct shingles)`` of every row.

    Fewer than ``width`` words give one shingle of the whole sequence, and a row
    without words gives none.
    """
    if not 1 <= width <= WIDTH:
        raise ValueError(f"shingle width must be 1 to {WIDTH}")
    for a, b, words, counts in word_hashes(raw, offsets):
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
            for k in range(width):
                rolled += words[k : len(words) - width + 1 + k] * _FACTORS[k] if len(rolled) else np.uint64(0)
        rolled = mix(rolled)
        at = 0
        for row, n in zip(range(a, b), counts.tolist()):
            if n >= width:
                one = np.sort(rolled[at : at + n - width + 1])
                if len(one) > 1:
                    keep = np.empty(len(one), dtype=bool)
                    keep[0] = True
                    np.not_equal(one[1:], one[:-1], out=keep[1:])
                    one = one[keep]
            elif n:
                with np.errstate(over="ignore"):
                    one = mix(np.array([(words[at : at + n] * _FACTORS[:n]).sum(dtype=np.uint64) + _SHORT[n]], dtype=np.uint64))
            else:
                one = np.empty(0, np.uint64)
            at += n
            yield row, one
