"""Words and word sequences of whole Arrow columns as 64-bit numbers.

A word is a run of bytes other than space and 0x09-0x0D, A-Z lower-cased. Two words
count as equal if their 64-bit hashes are; with a billion different words that errs
with a probability of about 0.03 for the whole collection.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP = 0x9E3779B97F4A7C15
SLICE_BYTES = 1_000_000
_WRAP = (1 << 64) - 1


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbers(count: int, seed: int) -> np.ndarray:
    """Fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(STEP) + np.uint64(seed))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Every ASCII byte but letters and digits.
MARKS = np.array([byte < 128 and not chr(byte).isalnum() for byte in range(256)])
_OF_BYTE = numbers(256, 11)[_LOWER]
_PLACES = numbers(16, 23) | np.uint64(1)
_LENGTHS = numbers(16, 37)
_INVERSE = pow(STEP, -1, 1 << 64)
_powers = {STEP: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, count: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    if len(_powers[base]) < count:
        size = max(count, SLICE_BYTES + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:count]


def give_back() -> None:
    """Return memory that is free to the machine: a Python worker that ran a stage before keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fresh(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that a table doesn't have."""
    taken = {one.lower() for one in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Words(NamedTuple):
    """The words of some texts in order; ``first[i]:first[i + 1]`` are those of text i."""

    values: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice has one row or at most ``limit`` bytes of text."""
    _, ends = texts(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def windows(column: pa.Array, between: np.ndarray = _SPACE, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Each row's number with stretches of its text that end where words end."""
    data, ends = texts(column)
    for row in range(len(column)):
        at, end = int(ends[row]), int(ends[row + 1])
        while at < end:
            to = min(at + limit, end)
            while to < end and not between[data[to]]:
                step = np.flatnonzero(between[data[to : min(to + limit, end)]])
                to = to + int(step[0]) if len(step) else min(to + limit, end)
            yield row, pa.array([data[at:to].tobytes()], pa.large_binary()).cast(pa.large_string())
            at = to


def words(column: pa.Array, between: np.ndarray = _SPACE) -> Words:
    """The words of each text; ``between`` marks the bytes that part them."""
    data, ends = texts(column)
    solid = ~between[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    begins[heads] = solid[heads]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    tails = ends[1:][ends[1:] > 0] - 1
    stops[tails] = solid[tails]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_OF_BYTE[data] * _power(STEP, len(data)), out=sums[1:], dtype=np.uint64)
        plain = (sums[stop] - sums[start]) * _power(_INVERSE, len(data) + 1)[start]
        values = mix(plain + (stop - start).astype(np.uint64))
    return Words(values, np.searchsorted(start, ends))


def sequences(found: Words, size: int) -> Words:
    """Every run of ``size`` words; of a text with fewer, all its words as one run."""
    values, first = found
    counts = found.counts
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    to = np.concatenate(([0], np.cumsum(runs)))
    owner = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(to[-1]) - to[:-1][owner] + first[:-1][owner]
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), np.uint64)
        length = np.minimum(counts, size)[owner]
        short = bool(len(length)) and int(length.min()) < size
        for place in range(size):
            if short:
                inside = place < length
                total[inside] += values[at[inside] + place] * _PLACES[place]
            else:
                total += values[at + place] * _PLACES[place]
        return Words(mix(total + _LENGTHS[length]), to)


def distinct(found: Words) -> Words:
    """Each text's different values in ascending order."""
    owner = found.owner
    order = np.lexsort((found.values, owner))
    values, owner = found.values[order], owner[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[keep], minlength=len(found.first) - 1)
    return Words(values[keep], np.concatenate(([0], np.cumsum(counts))))
