"""Token ids of whole texts, with the tokenizers library called once per different piece."""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa

from tidings.llm.words import _INVERSE, STEP, _power, mix, numbers, texts

_OF_BYTE = numbers(256, 53)
_JOINED = 256


def _between(values: np.ndarray, least: int, most: int) -> np.ndarray:
    return (values >= least) & (values <= most)


def pieces(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin.

    A text is cut only between a character that surely isn't white space and a space or
    line feed. There both vocabularies' splitting patterns end a part as well, so a piece
    is encoded alike alone and in its text.
    """
    begins = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        before = _between(data[:-1], 0x21, 0x7E)
        before[1:] |= _between(data[:-2], 0xC3, 0xDF)
        before[2:] |= _between(data[:-3], 0xE4, 0xED)
        begins[1:] = ((data[1:] == 0x20) | (data[1:] == 0x0A)) & before
    begins[ends[:-1][ends[:-1] < len(data)]] = True
    return np.flatnonzero(begins)


class Encoder:
    """Encodes texts as the library does with ``add_special_tokens=False``.

    A special token that a text spells out is that token. The ids of up to ``kept`` different pieces
    are remembered by the pieces' 64-bit hashes, some 30 bytes each.
    """

    def __init__(self, path: str, kept: int = 1_500_000, between: str = "<|endoftext|>"):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._between, self._stop = between, self._tokenizer.token_to_id(between)
        self._kept = kept
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.zeros(0, np.uint64)
        self._at, self._size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self._ids = np.zeros(0, np.uint32)

    def _encode(self, missing: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts, many pieces in one call with a special token between them, which none of them has."""
        runs = [missing[at : at + _JOINED] for at in range(0, len(missing), _JOINED)]
        joined = [self._between.join(run) + self._between for run in runs]
        found = self._tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        stops = np.flatnonzero(ids == self._stop)
        return ids[ids != self._stop], np.diff(stops, prepend=-1) - 1

    def _learn(self, hashes: np.ndarray, missing: list[str]) -> None:
        ids, counts = self._encode(missing)
        if len(self._hashes) + len(hashes) > self._kept:
            self._forget()
        to = np.searchsorted(self._hashes, hashes)
        at = len(self._ids) + np.cumsum(counts) - counts
        self._ids = np.concatenate((self._ids, ids))
        self._hashes = np.insert(self._hashes, to, hashes)
        self._at, self._size = np.insert(self._at, to, at), np.insert(self._size, to, counts.astype(np.int32))

    def _one_by_one(self, column: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same where the texts ``whole`` may spell out a special token: these are encoded uncut."""
        ids, size, at = [], [], 0
        for row in [*whole.tolist(), len(column)]:
            if row > at:
                found, counts = self(column.slice(at, row - at))
                ids.append(found)
                size.append(counts)
            if row < len(column):
                found = np.array(self._tokenizer.encode(column[row].as_py(), add_special_tokens=False).ids, np.uint32)
                ids.append(found)
                size.append(np.array([len(found)]))
            at = row + 1
        return np.concatenate(ids), np.concatenate(size)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of each text."""
        data, ends = texts(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        marks = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        if len(marks):
            return self._one_by_one(column, np.unique(np.searchsorted(ends, marks, side="right") - 1))
        start = pieces(data, ends)
        stop = np.append(start[1:], len(data))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_OF_BYTE[data] * _power(STEP, len(data)), out=sums[1:], dtype=np.uint64)
            hashes = mix((sums[stop] - sums[start]) * _power(_INVERSE, len(data))[start] + (stop - start).astype(np.uint64))
        different, which, back = np.unique(hashes, return_index=True, return_inverse=True)
        for _ in range(2):
            place = np.searchsorted(self._hashes, different)
            if len(self._hashes):
                known = self._hashes[np.minimum(place, len(self._hashes) - 1)] == different
            else:
                known = np.zeros(len(different), dtype=bool)
            if known.all():
                break
            if len(self._hashes) + np.count_nonzero(~known) > self._kept:
                self._forget()
                known[:] = False
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            self._learn(different[new], [raw[a:b].decode() for a, b in zip(start[which[new]], stop[which[new]])])
        size, at = self._size[place][back].astype(np.int64), self._at[place][back]
        total = np.cumsum(size)
        ids = self._ids[np.arange(total[-1]) + np.repeat(at - total + size, size)]
        per_text = np.concatenate(([0], total))[np.searchsorted(start, ends)]
        return ids, np.diff(per_text)


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
