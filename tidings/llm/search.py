"""The best documents for each of many short texts, by branch and bound over a document FP-tree.

Terms are runs of ASCII letters, digits and bytes from 0x80, A-Z lower-cased, as 64-bit hashes.
Scores are whole numbers: a term weighs floor(1000 * ln((2N + 2) / (2 df + 1))), a document has
m = 100 - b + (b * n * N) div L with b = 90, and a term that it has tf times adds
weight * ((1000000000 * tf) div (1000 * tf + 8 * m)).

First pass: documents are cut down to the terms that the items have, and these vectors are written,
with each task's share of N, L and the df. Second pass: each task takes its vectors in
bundles. A bundle's vectors, their terms in descending df, are sorted; equal beginnings are then
paths of a trie, and a node is a run of neighbouring documents. Small neighbours share one leaf. Every node
knows the largest tf of each term below it and the least m, so the score of whatever is below has a bound.
An item descends depth first into the nodes with the highest bounds, scores a leaf's documents
exactly, and leaves out every node whose bound is below the worst of its best so far, which also earlier
bundles of the task have raised. A task gives no more rows than the items ask for.

Items are taken in blocks of at most ``block_terms`` different terms, that is what a broadcast
holds; each block reads the documents once. Nulls: a null text has no term; as an item it gets no row.
A document with a null id ranks after all others of its score. Equal rows are documents each, and items
each; items are told apart by their place and not by ``item_id``. Very long texts are read in windows. Other
columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidings.llm.words import MARKS, SLICE_BYTES, slices, texts, windows, words
from tidings.plans import Workspace

#: Share of m, in percent, that follows the document's length.
B = 90
NO_ID = (1 << 63) - 1

VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>, texts long, tokens long"
RANKED = "item int, doc_id long, score long"
#: Parts into which each item's rows are dealt before their last ranking.
PARTS = 64


class Sizes(NamedTuple):
    """What a task holds; results don't depend on it."""

    bundle_docs: int = 20_000
    bundle_terms: int = 2_000_000
    leaf_docs: int = 256


class Counted(NamedTuple):
    """Terms of each text: rows, their known terms and tfs in ascending order, and n of every text."""

    row: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    n: np.ndarray


def count(column: pa.Array, known: np.ndarray) -> Counted:
    """``known`` are the hashes of terms, ascending; a term is called by its place there."""
    _, ends = texts(column)
    n = np.zeros(len(column), np.int64)
    owners, values = [], []
    if len(ends) and ends[-1] > 2 * SLICE_BYTES:
        found = ((np.full(1, row), words(part, MARKS)) for row, part in windows(column, MARKS))
    else:
        found = iter([(np.arange(len(column)), words(column, MARKS))])
    for rows, some in found:
        np.add.at(n, rows, some.counts)
        at = np.searchsorted(known, some.values)
        at[at == len(known)] = 0
        held = known[at] == some.values if len(known) else np.zeros(len(at), dtype=bool)
        owners.append(rows[some.owner[held]])
        values.append(at[held])
    owner, value = (np.concatenate(one) if one else np.zeros(0, np.int64) for one in (owners, values))
    both, tf = np.unique(owner * max(len(known), 1) + value, return_counts=True)
    return Counted(both // max(len(known), 1), both % max(len(known), 1), tf, n)


def _vectors(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Vectors of the texts that have a known term, and at last what the task adds to N, L and the df."""
    having = tokens = 0
    df = np.zeros(len(known), np.int64)

    def rows(ids: pa.Array, n, first, terms, tfs, having, tokens) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(one, pa.int32())) for one in (terms, tfs)]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), *lists, pa.array(having, pa.int64()), pa.array(tokens, pa.int64())],
            ["doc_id", "n", "terms", "tfs", "texts", "tokens"],
        )

    for batch in batches:
        for some in slices(batch, "text"):
            found = count(some.column("text"), known)
            having += int((found.n > 0).sum())
            tokens += int(found.n.sum())
            df += np.bincount(found.term, minlength=len(df))
            kept, starts = np.unique(found.row, return_index=True)
            if len(kept):
                none = [None] * len(kept)
                yield rows(some.column("doc_id").take(pa.array(kept)), found.n[kept], np.append(starts, len(found.row)), found.term, found.tf, none, none)
    at = np.flatnonzero(df)
    while len(df):  # tf holds the df here, in portions that an int has room for
        part = np.minimum(df[at], 2**31 - 1)
        yield rows(pa.array([None], pa.int64()), [None], [0, len(at)], at, part, [having], [tokens])
        having = tokens = 0
        df[at] -= part
        at = np.flatnonzero(df)
        if not len(at):
            break


class Item(NamedTuple):
    """Terms of an item by their rank, and what they weigh."""

    terms: np.ndarray
    weights: np.ndarray


def gains(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What terms add to scores; 0 where tf is 0."""
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Tree:
    """A trie of sorted term vectors; nodes are runs of documents, a parent before its children.

    Only nodes of more than ``leaf`` documents are opened, and neighbouring small children
    are bundled up to that number, so nodes are few against documents.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, first: np.ndarray, terms: np.ndarray, tfs: np.ndarray, leaf: int):
        """``terms`` are ranks by descending df, ascending in each document."""
        keys = terms.astype(">u4")
        order = sorted(range(len(ids)), key=lambda at: keys[first[at] : first[at + 1]].tobytes())
        order = np.array(order, np.int64)
        size = np.diff(first)[order]
        start = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(first[:-1][order] - start[:-1], size) + np.arange(start[-1])
        self.ids, self.m = ids[order], m[order]
        self._open(start, terms[at], leaf)
        doc = np.repeat(np.arange(len(order)), size)
        self._fill(doc, terms[at], tfs[at])

    def _open(self, start: np.ndarray, terms: np.ndarray, leaf: int) -> None:
        """Nodes by their runs: [low, high), parent, and the number of children, -1 for a leaf."""
        size = np.diff(start)
        low, high, parent = [0], [len(size)], [-1]
        self.children: list[list[int]] = [[]]
        at = 0
        while at < len(low):
            a, b = low[at], high[at]
            if b - a > leaf:
                d = _shared(terms[start[a] : start[a + 1]], terms[start[b - 1] : start[b]])
                # The whole run shares that much of its path. Documents that end there come first.
                next_term = np.full(b - a, -1, np.int64)
                longer = size[a:b] > d
                next_term[longer] = terms[start[a:b][longer] + d]
                heads = np.concatenate(([0], np.flatnonzero(next_term[1:] != next_term[:-1]) + 1, [b - a]))
                if len(heads) == 2 and next_term[0] < 0:
                    heads = np.append(np.arange(0, b - a, leaf), b - a)  # equal vectors: any cut will do
                runs, since = [], 0
                for one in range(1, len(heads)):
                    whole = heads[one] - heads[one - 1] > leaf
                    if whole or heads[one] - since > leaf:
                        if heads[one - 1] > since:
                            runs.append((since, heads[one - 1]))
                        since = heads[one - 1]
                    if whole:
                        runs.append((since, heads[one]))
                        since = heads[one]
                if since < b - a:
                    runs.append((since, b - a))
                for x, y in runs:
                    self.children[at].append(len(low))
                    low.append(a + int(x))
                    high.append(a + int(y))
                    parent.append(at)
                    self.children.append([])
            at += 1
        self.low, self.high, self.parent = np.array(low), np.array(high), np.array(parent)
        self.least_m = np.array([self.m[a:b].min() if b > a else 0 for a, b in zip(low, high)], np.int64)

    def _fill(self, doc: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """Postings of each term, and for each term the nodes that have it with the largest tf below."""
        order = np.lexsort((doc, terms))
        self.doc, self.tf, term = doc[order], tfs[order], terms[order]
        self.posted = _runs(term)
        leaves = np.flatnonzero([not one for one in self.children])
        leaves = leaves[np.argsort(self.low[leaves])]
        node = leaves[np.searchsorted(self.low[leaves], self.doc, side="right") - 1]
        most, every = self.tf, []
        while len(node):
            key = term * len(self.low) + node
            by = np.argsort(key, kind="stable")
            key, most = key[by], most[by]
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            most, key = np.maximum.reduceat(most, heads), key[heads]
            term, node = key // len(self.low), key % len(self.low)
            every.append((term, node, most))
            up = self.parent[node]
            inner = up >= 0
            term, node, most = term[inner], up[inner], most[inner]
        if every:
            term, node, most = (np.concatenate(one) for one in zip(*every))
            key = term * len(self.low) + node
            by = np.lexsort((-most, key))
            by = by[np.concatenate(([True], key[by][1:] != key[by][:-1]))]
            self.known, self.at, self.most = _runs(term[by]), node[by], most[by]
        else:
            self.known, self.at, self.most = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def bounds(self, item: Item) -> np.ndarray:
        """For each node, no less than any score below it."""
        total = np.zeros(len(self.low), np.int64)
        for term, weight in zip(item.terms.tolist(), item.weights):
            if term in self.known:
                a, b = self.known[term]
                node = self.at[a:b]
                total[node] += gains(weight, self.most[a:b], self.least_m[node])
        return total

    def scores(self, item: Item, low: int, high: int) -> np.ndarray:
        """The scores of a run of documents."""
        total = np.zeros(high - low, np.int64)
        for term, weight in zip(item.terms.tolist(), item.weights):
            if term in self.posted:
                a, b = self.posted[term]
                some = slice(a + np.searchsorted(self.doc[a:b], low), a + np.searchsorted(self.doc[a:b], high))
                doc = self.doc[some]
                total[doc - low] += gains(weight, self.tf[some], self.m[doc])
        return total

    def search(self, item: Item, best: list[tuple[int, int]], most: int) -> None:
        """Raise ``best``, a heap of (score, minus id), by what this tree has."""
        bounds = self.bounds(item)
        stack = [0]
        while stack:
            node = stack.pop()
            floor = best[0][0] if len(best) == most else 1
            if bounds[node] < floor:
                continue
            children = self.children[node]
            if children:
                order = np.argsort(bounds[children], kind="stable")
                stack.extend(children[at] for at in order if bounds[children[at]] >= floor)
                continue
            low, high = int(self.low[node]), int(self.high[node])
            total = self.scores(item, low, high)
            chosen = np.flatnonzero(total >= floor)
            if len(chosen) > most:
                chosen = chosen[np.lexsort((self.ids[low:high][chosen], -total[chosen]))[:most]]
            for at in chosen.tolist():
                row = (int(total[at]), -int(self.ids[low + at]))
                if len(best) < most:
                    heapq.heappush(best, row)
                elif row > best[0]:
                    heapq.heapreplace(best, row)


def _shared(first: np.ndarray, last: np.ndarray) -> int:
    """Terms with which both vectors begin."""
    size = min(len(first), len(last))
    other = np.flatnonzero(first[:size] != last[:size])
    return int(other[0]) if len(other) else size


def _runs(ordered: np.ndarray) -> dict[int, tuple[int, int]]:
    """Where each value of an ordered array begins and ends."""
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(ordered))
    return {int(value): (int(a), int(b)) for value, a, b in zip(ordered[heads], heads, ends)}


class Statistics(NamedTuple):
    """N, L, and for each known term its rank by descending df."""

    documents: int
    tokens: int
    ranks: np.ndarray


def _search(
    batches: Iterator[pa.RecordBatch], statistics: Statistics, items: dict[int, Item], most: int, sizes: Sizes
) -> Iterator[pa.RecordBatch]:
    """The task's best documents for each item."""
    best: dict[int, list[tuple[int, int]]] = {one: [] for one in items}
    held: list[tuple] = []

    def search() -> None:
        ids, n, size, terms, tfs = (np.concatenate(one) for one in zip(*held))
        held.clear()
        owner = np.repeat(np.arange(len(ids)), size)
        terms = statistics.ranks[terms]
        order = np.lexsort((terms, owner))
        m = 100 - B + (B * n * statistics.documents) // statistics.tokens
        tree = Tree(ids, m, np.concatenate(([0], np.cumsum(size))), terms[order], tfs[order], sizes.leaf_docs)
        for one, item in items.items():
            tree.search(item, best[one], most)

    docs = postings = 0
    for batch in batches:
        for low in range(0, batch.num_rows, min(1000, sizes.bundle_docs)):
            some = batch.slice(low, min(1000, sizes.bundle_docs))
            terms, tfs = some.column("terms"), some.column("tfs")
            held.append(
                (
                    some.column("doc_id").fill_null(NO_ID).to_numpy(),
                    some.column("n").to_numpy(),
                    terms.value_lengths().to_numpy(),
                    terms.flatten().to_numpy().astype(np.int64),
                    tfs.flatten().to_numpy().astype(np.int64),
                )
            )
            docs, postings = docs + some.num_rows, postings + len(terms.flatten())
            if docs >= sizes.bundle_docs or postings >= sizes.bundle_terms:
                search()
                docs = postings = 0
    if held:
        search()
    found = [(one, None if -minus == NO_ID else -minus, score) for one, rows in best.items() for score, minus in rows]
    for low in range(0, len(found), 10_000):
        columns = list(zip(*found[low : low + 10_000]))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["item", "doc_id", "score"])


def _blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Items with the hashes of their terms, as many as have ``block_terms`` different ones."""
    block: list[tuple[int | None, np.ndarray]] = []
    terms: set[int] = set()
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in rows.where("text IS NOT NULL").toLocalIterator():
        own = [np.unique(words(part, MARKS).values) for _, part in windows(pa.array([row.text], pa.string()), MARKS)]
        own = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        if block and len(terms.union(own.tolist())) > block_terms:
            yield block
            block, terms = [], set()
        block.append((row.item_id, own))
        terms.update(own.tolist())
    if block:
        yield block


def _block(rows: DataFrame, block: list[tuple[int | None, np.ndarray]], most: int, room: Workspace, number: int, sizes: Sizes) -> DataFrame:
    spark = rows.sparkSession
    known = np.unique(np.concatenate([terms for _, terms in block]))
    sent = spark.sparkContext.broadcast(known)
    vectors = room.hold(rows.mapInArrow(lambda batches: _vectors(batches, sent.value), VECTORS), f"vectors-{number}")
    sent.destroy()
    shares = vectors.where("texts IS NOT NULL")
    total = shares.agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens")).first()
    documents, tokens = total.texts or 0, total.tokens or 0
    df = np.zeros(len(known), np.int64)
    pairs = shares.select(F.explode(F.arrays_zip("terms", "tfs")).alias("one"))
    for row in pairs.groupBy("one.terms").agg(F.sum("one.tfs").alias("df")).collect():  # a row for a known term
        df[row.terms] = row.df
    ranks = np.empty(len(known), np.int64)
    ranks[np.argsort(-df, kind="stable")] = np.arange(len(known))
    items = {}
    for at, (_, terms) in enumerate(block):
        place = np.searchsorted(known, terms)
        place = place[df[place] > 0]
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(one) + 1))) for one in df[place]]
        if len(place):
            items[at] = Item(ranks[place], np.array(weights, np.int64))
    asked = spark.sparkContext.broadcast((Statistics(documents, max(tokens, 1), ranks), items))
    found = vectors.where("texts IS NULL").mapInArrow(lambda batches: _search(batches, *asked.value, most, sizes), RANKED)
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*by))).where(F.col("rank") <= most)
    last = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= most)
    names = spark.createDataFrame([(at, one) for at, (one, _) in enumerate(block)], "item int, item_id long")
    return last.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a block's items


def ranked(
    docs: DataFrame,
    items: DataFrame,
    most: int = 10,
    block_terms: int = 200_000,
    room: Workspace | None = None,
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """``item_id``, ``rank`` from 1, ``doc_id`` and ``score`` of each item's best documents with scores above 0."""
    room = room or Workspace(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for number, block in enumerate(_blocks(items, block_terms)):
        some = _block(rows, block, most, room, number, sizes)
        found = some if found is None else found.unionByName(some)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found
