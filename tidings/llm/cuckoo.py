"""A cuckoo filter over 128-bit keys, filled, emptied and probed by whole arrays.

A key is two 64-bit numbers: the first places it, the second gives its 32-bit mark. A mark
lies in one of two buckets of four slots, and either bucket with the mark gives the other, so a
mark can move without its key, and a key that was put in can be taken out again.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from tidings.llm.words import mix

SLOTS = 4
#: Share of the slots that a new filter fills at most; it grows rather than fill up.
FULL = 0.8
ROUNDS = 500


class Full(Exception):
    """A mark found no place."""


def marks_of(second: np.ndarray) -> np.ndarray:
    """Never 0, which is an empty slot."""
    marks = (second & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return np.where(marks == 0, np.uint32(1), marks)


def _jump(marks: np.ndarray) -> np.ndarray:
    return mix(marks.astype(np.uint64))


def _first(first: np.ndarray) -> np.ndarray:
    return mix(first ^ np.uint64(0x5851F42D4C957F2D))


def empty(keys: int) -> np.ndarray:
    """Slots [bucket, slot] for so many keys; the number of buckets is a power of two."""
    buckets = 1
    while buckets * SLOTS * FULL < keys:
        buckets *= 2
    return np.zeros((buckets, SLOTS), np.uint32)


def _ranks(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal buckets together, and each one's rank among its equals in it."""
    order = np.argsort(buckets, kind="stable")
    ordered = buckets[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(ordered)))
    return order, np.arange(len(ordered)) - np.repeat(starts, sizes)


def _settle(slots: np.ndarray, buckets: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Put marks into free slots of their buckets; those that found none."""
    order, rank = _ranks(buckets)
    ordered = buckets[order]
    free = slots[ordered] == 0
    which = np.argsort(~free, axis=1, kind="stable")  # free slots first
    fits = rank < free.sum(axis=1)
    at = np.flatnonzero(fits)
    slots[ordered[at], which[at, rank[at]]] = marks[order[at]]
    left = np.ones(len(buckets), dtype=bool)
    left[order[at]] = False
    return left


def put(slots: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
    """Insert keys, each once; raises ``Full`` when marks went round and round."""
    wrap = np.uint64(len(slots) - 1)
    marks = marks_of(second)
    buckets = (_first(first) & wrap).astype(np.int64)
    for turn in range(ROUNDS):
        if not len(marks):
            return
        left = _settle(slots, buckets, marks)
        marks, buckets = marks[left], buckets[left]
        other = (buckets.astype(np.uint64) ^ (_jump(marks) & wrap)).astype(np.int64)
        left = _settle(slots, other, marks)
        marks, buckets = marks[left], other[left]
        # One mark of each full bucket makes room and goes on to its other bucket.
        order, rank = _ranks(buckets)
        pushing = order[rank == 0]
        slot = (turn + buckets[pushing]) % SLOTS
        moved = slots[buckets[pushing], slot]
        slots[buckets[pushing], slot] = marks[pushing]
        marks[pushing] = moved
        buckets[pushing] = (buckets[pushing].astype(np.uint64) ^ (_jump(moved) & wrap)).astype(np.int64)
    raise Full


def take(slots: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
    """Remove keys that were put in, each once."""
    wrap = np.uint64(len(slots) - 1)
    marks = marks_of(second)
    near = (_first(first) & wrap).astype(np.int64)
    for _ in range(2):
        # Equal marks of one bucket take one slot each.
        order, rank = _ranks((near.astype(np.uint64) << np.uint64(32) | marks.astype(np.uint64)).astype(np.uint64))
        held = slots[near[order]] == marks[order][:, None]
        which = np.argsort(~held, axis=1, kind="stable")
        at = np.flatnonzero(rank < held.sum(axis=1))
        slots[near[order[at]], which[at, rank[at]]] = 0
        left = np.ones(len(marks), dtype=bool)
        left[order[at]] = False
        marks, near = marks[left], near[left]
        if not len(marks):
            return
        near = (near.astype(np.uint64) ^ (_jump(marks) & wrap)).astype(np.int64)
    raise KeyError("a key that isn't in the filter can't be taken out")


def built(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A filter of the keys, as large as it must be."""
    slots = empty(len(first))
    while True:
        try:
            put(slots, first, second)
            return slots
        except Full:
            slots = np.zeros((2 * len(slots), SLOTS), np.uint32)


class Shards(NamedTuple):
    """The filters of all shards in one array; a key's shard is the top bits of its first number."""

    bits: int
    slots: np.ndarray
    base: np.ndarray
    wrap: np.ndarray

    @classmethod
    def of(cls, bits: int, filters: dict[int, np.ndarray]) -> Shards:
        """A shard that is missing holds nothing."""
        nothing = np.zeros((1, SLOTS), np.uint32)
        every = [filters.get(shard, nothing) for shard in range(1 << bits)]
        sizes = np.array([len(one) for one in every], np.int64)
        return cls(bits, np.concatenate(every), np.cumsum(sizes) - sizes, (sizes - 1).astype(np.uint64))

    def holds(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether a shard's filter has each key's mark."""
        shard = shard_of(first, self.bits)
        wrap, base, marks = self.wrap[shard], self.base[shard], marks_of(second)
        near = _first(first) & wrap
        other = near ^ (_jump(marks) & wrap)
        found = np.zeros(len(first), dtype=bool)
        for bucket in (near, other):
            at = base + bucket.astype(np.int64)
            for slot in range(SLOTS):
                found |= self.slots[at, slot] == marks
        return found


def shard_of(first: np.ndarray, bits: int) -> np.ndarray:
    return (first >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(first), np.int64)
