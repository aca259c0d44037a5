"""Ranked search against brute force."""

import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidings.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda found: found[0].lower(), text or ""))


def brute(docs, items, most=10):
    """(item_id, rank, doc_id, score) of the rows; a null id comes after its equals."""
    bags = [(one, Counter(terms(text))) for one, text in docs]
    count = sum(1 for _, bag in bags if bag)
    total = sum(sum(bag.values()) for _, bag in bags)
    df = Counter(term for _, bag in bags for term in bag)
    found = []
    for item, text in items:
        scored = []
        for one, bag in bags:
            score = 0
            for term in set(terms(text)) & bag.keys():
                weight = math.floor(1000 * math.log((2 * count + 2) / (2 * df[term] + 1)))
                m = 100 - 90 + (90 * sum(bag.values()) * count) // total
                score += weight * ((1000000000 * bag[term]) // (1000 * bag[term] + 8 * m))
            if score > 0:
                scored.append((-score, one is None, one or 0, one))
        found += [(item, rank, one, -minus) for rank, (minus, _, _, one) in enumerate(sorted(scored)[:most], 1)]
    return sorted(found, key=repr)


def collected(found):
    return sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def drawn(seed, size, vocabulary=60):
    draw = random.Random(seed)
    return " ".join(f"w{min(int(draw.expovariate(0.08)), vocabulary)}" for _ in range(size))


@pytest.fixture(scope="module")
def table():
    """Copies, ties, empty, null, odd and long texts, null and repeated ids."""
    found = [(one, drawn(one, 5 + one % 40)) for one in range(150)]
    found += [(1000 + at, drawn(7, 30)) for at in range(40)]
    found += [(500, None), (501, ""), (502, "-- !!"), (503, "Größe größe GRÖSSE w1"), (504, "w1_w2"), (505, drawn(9, 5000))]
    found += [(None, drawn(7, 30)), (None, "w3 w4"), (7, "tied w5"), (7, "tied w5")]
    return found


ITEMS = [(1, drawn(7, 12)), (2, "größe W1"), (3, None), (4, ""), (5, "nothing here fits"), (6, drawn(3, 40)), (6, "tied"), (None, "w59 w58 w1 w1")]


def frames(spark, table):
    docs = spark.createDataFrame([(one, text, 1, 2) for one, text in table], "doc_id long, text string, score int, terms int").repartition(3)
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize(("sizes", "block"), [(search.Sizes(), 200_000), (search.Sizes(leaf_docs=4), 200_000), (search.Sizes(30, 100, 2), 10)])
def test_ranks_agree_with_brute_force(spark, table, sizes, block):
    docs, items = frames(spark, table)
    assert collected(search.ranked(docs, items, block_terms=block, sizes=sizes)) == brute(table, ITEMS)


def test_no_rows(spark, table):
    docs, items = frames(spark, table)
    assert search.ranked(docs.limit(0), items).collect() == []
    assert search.ranked(docs, items.limit(0)).collect() == []
    assert search.ranked(docs, items.where("text IS NULL OR text = ''")).collect() == []


@pytest.mark.parametrize("leaf", [1, 3, 50, 1000])
def test_tree_finds_the_best_and_leaves_the_rest_out(leaf):
    """The tree by itself: bounds hold, and the best are those of a full scan."""
    draw = np.random.default_rng(leaf)
    size = draw.integers(0, 12, 400)
    first = np.concatenate(([0], np.cumsum(size)))
    ranks = np.concatenate([np.sort(draw.choice(40, one, replace=False)) for one in size]).astype(np.int64)
    tf = draw.integers(1, 9, len(ranks))
    ids, m = np.arange(400)[::-1].copy(), draw.integers(10, 200, 400)
    tree = search.Tree(ids, m, first, ranks, tf, leaf=leaf)
    scored = []
    tree_scores = tree.scores
    tree.scores = lambda item, low, high: scored.append(high - low) or tree_scores(item, low, high)
    for seed in range(20):
        chosen = np.sort(np.random.default_rng(seed).choice(45, 5, replace=False))
        item = search.Item(chosen, np.arange(1, 6) * 1000)
        total = np.zeros(400, np.int64)
        for doc in range(400):
            for at in range(first[doc], first[doc + 1]):
                if ranks[at] in chosen:
                    total[doc] += int(item.weights[list(chosen).index(ranks[at])]) * (1_000_000_000 * int(tf[at]) // (1000 * int(tf[at]) + 8 * int(m[doc])))
        bounds = tree.bounds(item)
        by_id = dict(zip(ids.tolist(), total.tolist()))
        for node in range(len(tree.low)):
            assert all(bounds[node] >= by_id[one] for one in tree.ids[tree.low[node] : tree.high[node]].tolist())
        best = []
        tree.search(item, best, 10)
        expected = heapq.nlargest(10, [(score, -one) for one, score in by_id.items() if score > 0])
        assert sorted(best, reverse=True) == expected
    if leaf <= 3:
        assert sum(scored) < 20 * 400 * 0.9


def test_equal_vectors_are_parted():
    """A thousand copies make leaves of bounded size."""
    first = np.arange(0, 3001, 3)
    tree = search.Tree(np.arange(1000), np.full(1000, 50), first, np.tile([1, 5, 9], 1000), np.ones(3000, np.int64), leaf=16)
    leaves = [at for at, one in enumerate(tree.children) if not one]
    assert max(tree.high[at] - tree.low[at] for at in leaves) <= 16
    assert sum(tree.high[at] - tree.low[at] for at in leaves) == 1000


def test_long_texts_are_read_in_windows():
    text = " ".join(drawn(at, 500, 30) for at in range(40)) + " é" + "x" * 5000 + " w1"
    known = np.unique(search.words(pa.array(["w1 w2 w3 w30"]), search.MARKS).values)
    whole = search.count(pa.array([text, None, "w1"]), known)
    parts = list(search.windows(pa.array([text]), search.MARKS, 700))
    assert "".join(part[0].as_py() for _, part in parts) == text
    assert len(parts) > 50
    assert sum(len(search.words(part, search.MARKS).values) for _, part in parts) == whole.n[0] == len(terms(text))


def test_very_long_text(spark):
    """Ten million bytes in one row, beside short ones."""
    text = "w1 w2 filler " * 800_000
    docs = spark.createDataFrame([(1, text), (2, "w1 w3"), (3, "w9")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1 w3")], "item_id long, text string")
    rows = [(1, text), (2, "w1 w3"), (3, "w9")]
    assert collected(search.ranked(docs, items)) == brute(rows, [(1, "w1 w3")])
