"""Test items inside documents, by size-partitioned MinHash containment search.

Texts become sets of five-word shingles (fewer words: all of them as one). An item of
more than 64 shingles is searched in parts of 64. Documents of any length are cut into
blocks, and each two neighbouring blocks are one set of bounded size, so that a short
item's containment becomes a Jaccard similarity MinHash can see. Sets are partitioned by
size; in each partition the number of rows to a band follows from the least similarity
that an item with half of its shingles in the set can have, so an item whose two halves
lie apart is found too. Every hit is then verified by the item's exact containment
in the whole document.

Items of up to eight shingles are looked up by exact ones beside that, so none of them is missed. With the
default 128 hashes a longer item that lies together in the text is missed with a probability below 1e-4, one of
16 or more shingles below 1e-6; an item whose shingles are strewn over the text in more than two places may be missed.

Nulls and empty texts have no shingles: as items they are never found, as documents
they hold nothing. Equal items are found each; equal rows are reported each. Other
columns are ignored. An empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.words import Words, distinct, fresh, mix, numbers, sequences, slices, words
from tidings.plans import Workspace

SHINGLE = 5
HASHES = 128
PART = 64
BLOCKS = (16, 64)
MISSED = 1e-6
#: Items of so few shingles are found by exact ones as well.
SHORT = 8
HITS = "doc_id long, item_id long, containment double, item_shingles long"

_ROUNDS = (numbers(HASHES, 71) >> np.uint64(32)).astype(np.uint32)
_STEPS = (numbers(HASHES, 73) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash signatures [hash, group] of the groups that begin at ``starts``."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    found = np.empty((HASHES, len(starts)), np.uint32)
    for at in range(HASHES):
        found[at] = np.minimum.reduceat((short ^ _ROUNDS[at]) * _STEPS[at], starts)
    return found


def block_signatures(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """The same for groups of up to ``most`` values, many groups at a time."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    found = np.empty((HASHES, len(starts)), np.uint32)
    places = np.arange(most)[:, None]
    for low in range(0, len(starts), 2048):
        some = slice(low, low + 2048)
        inside = np.where(places < sizes[some], places, 0)
        square = short[starts[some] + inside]
        room = np.empty_like(square)
        for at in range(HASHES):
            np.bitwise_xor(square, _ROUNDS[at], out=room)
            np.multiply(room, _STEPS[at], out=room)
            np.minimum.reduce(room, axis=0, out=found[at, some])
    return found


def band_keys(signs: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys [band, group] of bands of ``rows`` hashes."""
    bands = HASHES // rows
    with np.errstate(over="ignore"):
        keys = np.repeat(numbers(bands, rows)[:, None], signs.shape[1], axis=1)
        for row in range(rows):
            keys = mix(keys ^ signs[row * bands : (row + 1) * bands])
    return keys


def rows_for(most: int, least: int, threshold: float) -> int:
    """Rows to a band for sets of up to ``most`` shingles and items of at least ``least``."""
    half = threshold / 2
    similar = min(1.0, half / (most / least + 1 - half))
    for rows in (4, 2):
        if (1 - similar**rows) ** (HASHES // rows) <= MISSED:
            return rows
    return 1


class Index(NamedTuple):
    """Items with their shingles, and for each block size and rows the sorted keys of parts."""

    ids: np.ndarray
    shingles: np.ndarray
    first: np.ndarray
    keys: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]]
    short: tuple[np.ndarray, np.ndarray]


def _sizes(block: int) -> list[tuple[int, int]]:
    """Size partitions of pairs of blocks: more than the first number, up to the second."""
    return [(0, block // 2), (block // 2, block), (block, 2 * block)]


def build(ids: np.ndarray, column: pa.Array, threshold: float) -> Index:
    found = sequences(words(column), SHINGLE)
    sets = distinct(found)
    length = np.maximum(-(-found.counts // PART), found.counts > 0)
    item = np.repeat(np.arange(len(ids)), length)
    rank = np.arange(len(item)) - (np.cumsum(length) - length)[item]
    start = found.first[item] + rank * PART
    size = np.minimum(found.first[item + 1] - start, PART)
    keys: dict[tuple[int, int, int], list] = {}
    if len(item):
        signs = signatures(found.values, start)
        for block, low, high in ((BLOCKS[0], 1, BLOCKS[0]), (BLOCKS[1], BLOCKS[0] + 1, PART)):
            for least, most in ((low, (low + high) // 2), ((low + high) // 2 + 1, high)):
                chosen = np.flatnonzero((size >= least) & (size <= most))
                for over, up in _sizes(block) if len(chosen) else ():
                    rows = rows_for(up, least, threshold)
                    some = band_keys(signs[:, chosen], rows)
                    keys.setdefault((block, over, rows), []).append((some.ravel(), np.tile(item[chosen], len(some))))
    merged = {}
    for name, groups in keys.items():
        value, owner = (np.concatenate(x) for x in zip(*groups))
        order = np.argsort(value, kind="stable")
        merged[name] = value[order], owner[order]
    return Index(ids, sets.values, sets.first, merged, _short(sets, threshold))


def _short(sets: Words, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the items of up to ``SHORT`` ones, and their items: as many of each as one that is held must share.

    MinHash tells little of so few shingles, and a block has many.
    """
    small = (sets.counts > 0) & (sets.counts <= SHORT)
    needed = sets.counts - np.ceil(threshold * sets.counts - 1e-9).astype(np.int64) + 1
    owner = sets.owner
    rank = np.arange(len(owner)) - sets.first[:-1][owner]
    chosen = np.flatnonzero(small[owner] & (rank < needed[owner]))
    order = chosen[np.argsort(sets.values[chosen], kind="stable")]
    return sets.values[order], owner[order]


def _short_candidates(index: Index, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Pairs [text, item] of the short items by exact shingles."""
    known, items = index.short
    if not len(known) or not len(values):
        return np.zeros((0, 2), np.int64)
    low, high = (np.searchsorted(known, values, side=side) for side in ("left", "right"))
    hit = np.flatnonzero(high > low)
    times = (high - low)[hit]
    at = np.repeat(low[hit] - np.cumsum(times) + times, times) + np.arange(times.sum())
    text = np.searchsorted(first, hit, side="right") - 1
    return np.unique(np.stack((np.repeat(text, times), items[at]), axis=1), axis=0)


def candidates(index: Index, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Different pairs [text, item] that share a band in some pair of blocks."""
    pairs = [np.zeros((0, 2), np.int64)]
    counts = np.diff(first)
    unit = BLOCKS[0]
    blocks = -(-counts // unit)
    owner = np.repeat(np.arange(len(counts)), blocks)
    if not len(owner):
        return pairs[0]
    rank = np.arange(len(owner)) - (np.cumsum(blocks) - blocks)[owner]
    start = first[owner] + rank * unit
    size = np.minimum(first[owner + 1] - start, unit)
    signs = block_signatures(values, start, size, unit)
    for block in BLOCKS:
        if block > unit:
            heads = np.flatnonzero(rank % (block // unit) == 0)
            signs = np.minimum.reduceat(signs, heads, axis=1)
            size, owner, rank = np.add.reduceat(size, heads), owner[heads], rank[heads] // (block // unit)
        follows = owner[1:] == owner[:-1]
        alone = np.ones(len(owner), dtype=bool)
        alone[:-1] &= ~follows
        alone[1:] &= ~follows
        left = np.flatnonzero(follows)
        signs_of = np.concatenate((np.minimum(signs[:, left], signs[:, left + 1]), signs[:, alone]), axis=1)
        size_of = np.concatenate((size[left] + size[left + 1], size[alone]))
        text_of = np.concatenate((owner[left], owner[alone]))
        for over, up in _sizes(block):
            inside = np.flatnonzero((size_of > over) & (size_of <= up))
            for rows in (4, 2, 1):
                if not len(inside) or (block, over, rows) not in index.keys:
                    continue
                known, items = index.keys[block, over, rows]
                keys = band_keys(signs_of[:, inside], rows).ravel()
                marked = np.zeros(1 << 20, dtype=bool)
                marked[known >> np.uint64(44)] = True
                hit = np.flatnonzero(marked[keys >> np.uint64(44)])
                low = np.searchsorted(known, keys[hit], side="left")
                times = np.searchsorted(known, keys[hit], side="right") - low
                at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
                pair = np.stack((np.repeat(text_of[inside][hit % len(inside)], times), items[at]), axis=1)
                pairs.append(np.unique(pair, axis=0))
    return np.unique(np.concatenate(pairs), axis=0)


def _search(index: Index, column: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, item and containment of every verified hit."""
    found = sequences(words(column), SHINGLE)
    pairs = candidates(index, found.values, found.first)
    pairs = np.unique(np.concatenate((pairs, _short_candidates(index, found.values, found.first))), axis=0)
    shares = np.zeros(len(pairs))
    for at, (text, item) in enumerate(pairs):
        wanted = index.shingles[index.first[item] : index.first[item + 1]]
        shares[at] = np.isin(wanted, found.values[found.first[text] : found.first[text + 1]]).mean()
    kept = shares >= threshold
    return pairs[kept, 0], pairs[kept, 1], shares[kept]


def find(docs: DataFrame, items: DataFrame, threshold: float = 0.8, block: int = 5_000) -> DataFrame:
    """A row per document and item of which it holds at least ``threshold``.

    Items are broadcast in blocks of about ``block``, each searched against all documents;
    an item's index takes about 4 KB. Documents aren't moved.
    """
    spark = docs.sparkSession
    asked = items.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where("text IS NOT NULL")
    blocks = max(1, -(-asked.count() // block))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for number in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).toArrow()
        some = some.sort_by([("item_id", "ascending"), ("text", "ascending")]).combine_chunks()
        ids = some["item_id"].combine_chunks()
        texts = some["text"].combine_chunks()
        sent = spark.sparkContext.broadcast((build(np.arange(len(some)), texts, threshold), ids))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, ids = sent.value
            for batch in batches:
                for one in slices(batch, "text"):
                    text, item, share = _search(index, one.column("text"), threshold)
                    yield pa.RecordBatch.from_arrays(
                        [
                            one.column("doc_id").take(pa.array(text, pa.int64())),
                            ids.take(pa.array(item, pa.int64())),
                            pa.array(share),
                            pa.array(np.diff(index.first)[item], pa.int64()),
                        ],
                        ["doc_id", "item_id", "containment", "item_shingles"],
                    )

        hits = rows.mapInArrow(run, HITS)
        found = hits if found is None else found.unionByName(hits)
    return found


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8, block: int = 5_000) -> DataFrame:
    """The documents that hold no item, with all their columns.

    Rows are matched by ``doc_id``, so a clean row goes too if it shares its id with one that
    holds an item; a row with a null id is judged by itself and goes only if a null id was hit.
    """
    own = fresh("_held", docs.columns)
    held = find(docs, items, threshold, block).select(F.col("doc_id").alias(own)).distinct()
    held = Workspace(docs.sparkSession).hold(held, "held")
    if held.count() * 16 <= 32 << 20:
        held = F.broadcast(held)  # its size was checked; the documents stay where they are
    return docs.join(held, docs["doc_id"].cast("long").eqNullSafe(F.col(own)), "left_anti")
