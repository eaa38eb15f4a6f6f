"""Cuckoo filters over 128-bit digests: sets that answer "surely not" and can forget a member."""

from __future__ import annotations

import numpy as np

SLOTS = 4
MAX_KICKS = 500
LOAD = 0.85
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Full(Exception):
    """No free slot was found; the filter is as it was before the insertion."""


def buckets_for(members: int) -> int:
    """Buckets, a power of two, in which ``members`` fit at the usual load."""
    need = max(1, int(np.ceil(members / (SLOTS * LOAD))))
    return 1 << (need - 1).bit_length()


def _places(high: np.ndarray, low: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and both buckets; each bucket follows from the other and the fingerprint."""
    mask = np.uint64(buckets - 1)
    mark = (high >> np.uint64(48)).astype(np.uint16)
    mark = np.where(mark == 0, np.uint16(1), mark)  # 0 is a free slot
    one = low & mask
    with np.errstate(over="ignore"):
        jump = (mark.astype(np.uint64) * _MIX) >> np.uint64(32)
    return mark, one.astype(np.int64), (one ^ (jump & mask)).astype(np.int64)


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots.

    A digest comes as two unsigned 64-bit halves. Inserting a digest twice takes two
    slots, so whoever deletes must have inserted; the callers here insert every
    digest once.
    """

    def __init__(self, buckets: int, table: bytes | None = None) -> None:
        if buckets < 1 or buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), dtype=np.uint16) if table is None else np.frombuffer(table, dtype=np.uint16).reshape(buckets, SLOTS).copy()

    def table(self) -> bytes:
        return self.slots.tobytes()

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        mark, one, two = _places(high, low, self.buckets)
        return (self.slots[one] == mark[:, None]).any(axis=1) | (self.slots[two] == mark[:, None]).any(axis=1)

    def _put(self, mark: int, one: int, two: int) -> None:
        for bucket in (one, two):
            row = self.slots[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = mark
                return
        path, bucket = [], two
        for kick in range(MAX_KICKS):
            slot = (kick + mark) % SLOTS
            path.append((bucket, slot))
            mark, self.slots[bucket, slot] = int(self.slots[bucket, slot]), mark
            bucket ^= ((mark * int(_MIX) & (2**64 - 1)) >> 32) & (self.buckets - 1)
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = mark
                return
        for bucket, slot in reversed(path):  # undo, so that nothing that was in is lost
            mark, self.slots[bucket, slot] = int(self.slots[bucket, slot]), mark
        raise Full

    def insert(self, high: np.ndarray, low: np.ndarray) -> None:
        for place in zip(*(x.tolist() for x in _places(high, low, self.buckets)), strict=True):
            self._put(*place)

    def delete(self, high: np.ndarray, low: np.ndarray) -> None:
        for mark, one, two in zip(*(x.tolist() for x in _places(high, low, self.buckets)), strict=True):
            for bucket in (one, two):
                held = np.flatnonzero(self.slots[bucket] == mark)
                if len(held):
                    self.slots[bucket, held[0]] = 0
                    break
            else:
                raise KeyError("a digest was deleted that is not in the filter")


def filter_of(high: np.ndarray, low: np.ndarray, buckets: int | None = None) -> CuckooFilter:
    """A filter of all digests given, in twice the buckets as often as they don't fit."""
    buckets = max(buckets or 1, buckets_for(len(high)))
    while True:
        made = CuckooFilter(buckets)
        try:
            made.insert(high, low)
        except Full:
            buckets *= 2
        else:
            return made
