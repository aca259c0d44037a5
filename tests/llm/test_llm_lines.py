"""Line dedup against brute force, and the index's way back."""

import re
from collections import Counter

import numpy as np
import pytest

from tidings.llm import cuckoo, lines
from tidings.llm.lines import LineIndex
from tidings.plans import Workspace


def key_of(line):
    return re.sub("[A-Z]", lambda found: found[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def counted(texts):
    return Counter(key for text in texts for key in {key_of(line) for line in (text or "").split("\n")} if key)


def brute(rows, counts, least_docs=3, least_chars=1):
    found = []
    for one, text in rows:
        own = (text or "").split("\n")
        kept = [line for line in own if not (len(key_of(line)) >= least_chars and counts[key_of(line)] >= least_docs)]
        found.append((one, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(found, key=repr)


def collected(found):
    return sorted(map(tuple, found.collect()), key=repr)


COMMON = ["Menu", "  share this ", "Été"]
ROWS = [(one, f"own {one}\n{COMMON[one % 3]}\nonly {one % 40}\n\n MENU\t") for one in range(60)]
ROWS += [(100, None), (101, ""), (102, "\n\n"), (103, "x\r\nMenu\r\n"), (104, "Menu\nMenu\nMenu"), (105, "tail\n"), (106, "long " * 300_000 + "\nmenu")]
ROWS += [(None, "only here\nmenu"), (7, "tied\nonly 3"), (7, "tied\nonly 3"), (8, "\xa0menu"), (9, "été")]
MORE = [(200 + at, f"own {at}\nnew line\nmenu") for at in range(12)] + [(None, None), (300, "only 39")]


def frame(spark, rows):
    """Further columns have the names of the answer's."""
    return spark.createDataFrame([(one, text, 1, "k", 2) for one, text in rows], "doc_id long, text string, n_lines int, kept string, h1 int").repartition(4)


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize(("least_docs", "least_chars"), [(3, 1), (3, 6), (1, 1)])
def test_lines_agree_with_brute_force(spark, exact, least_docs, least_chars):
    docs = frame(spark, ROWS)
    index = LineIndex(spark, Workspace(spark), least_docs, least_chars)
    index.insert(docs)
    found = index.clean(docs, exact)
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert collected(found) == brute(ROWS, counted([text for _, text in ROWS]), least_docs, least_chars)


def test_insert_and_delete_are_each_others_way_back(spark):
    room = Workspace(spark)
    index = LineIndex(spark, room, least_docs=3)
    docs, more = frame(spark, ROWS), frame(spark, MORE)
    index.insert(docs)
    before = collected(index.counts())
    index.insert(more)
    both = [text for _, text in ROWS + MORE]
    again = LineIndex(spark, room, least_docs=3)  # another run goes on with the same state
    assert collected(again.clean(more)) == brute(MORE, counted(both))
    again.delete(more)
    assert collected(index.counts()) == before
    assert collected(index.clean(docs)) == brute(ROWS, counted([text for _, text in ROWS]))
    some = ROWS[::2]
    index.delete(frame(spark, some))
    left = ROWS[1::2]
    assert collected(index.clean(frame(spark, left))) == brute(left, counted([text for _, text in left]))
    index.delete(frame(spark, left))
    assert index.counts().collect() == []


def test_only_documents_that_are_in_come_out(spark):
    """A refused change leaves the index as it was, even if every line of the document is in."""
    index = LineIndex(spark, Workspace(spark), least_docs=3)
    docs = frame(spark, ROWS)
    index.insert(docs)
    before = collected(index.counts())
    with pytest.raises(Exception, match="never put in"):
        index.delete(frame(spark, [(900, "menu")]))
    assert collected(index.counts()) == before
    assert collected(index.clean(docs)) == brute(ROWS, counted([text for _, text in ROWS]))


def test_large_filters_and_more_shards(spark, monkeypatch):
    """Without room for a broadcast the counts decide; shards that double keep what is in."""
    monkeypatch.setattr(lines, "SHARD_KEYS", 4)
    index = LineIndex(spark, Workspace(spark), least_docs=3, filter_mb=0)
    docs, more = frame(spark, ROWS), frame(spark, MORE)
    index.insert(more)
    bits = index._version()[1]
    index.insert(docs)
    assert index._version()[1] > bits
    both = [text for _, text in ROWS + MORE]
    assert collected(index.clean(docs)) == brute(ROWS, counted(both))


def test_no_rows(spark):
    docs = frame(spark, ROWS)
    index = LineIndex(spark, Workspace(spark), least_docs=3)
    nothing = [(one, text) for one, text in ROWS]
    assert collected(index.clean(docs)) == brute(nothing, Counter())
    index.insert(docs.limit(0))
    assert index.counts().collect() == []
    assert collected(index.clean(docs)) == brute(nothing, Counter())
    assert index.clean(docs.limit(0)).collect() == []
    assert index.clean(docs.limit(0), exact=True).collect() == []


def test_rare_lines_that_the_filter_takes_for_common_stay(spark, monkeypatch):
    """With marks of three bits nearly every rare key meets a common one's."""
    monkeypatch.setattr(cuckoo, "marks_of", lambda second: (second & np.uint64(7)).astype(np.uint32) + np.uint32(1))
    keys = np.random.default_rng(5).integers(0, 2**63, (400, 2)).astype(np.int64)
    docs = np.where(np.arange(400) < 60, 10, 1)
    import pyarrow as pa

    size = len(keys)
    table = pa.table({
        "shard": pa.array([3] * size, pa.int32()), "kind": pa.array([lines.LINE] * size, pa.int8()), "h1": pa.array(keys[:, 0]), "h2": pa.array(keys[:, 1]),
        "docs": pa.array(docs), "was": pa.array([0] * size, pa.int64()), "slots": pa.array([None] * size, pa.binary()),
    })
    found = lines._update(table, 10).to_pylist()[-1]
    slots = np.frombuffer(found["slots"], np.uint32).reshape(-1, cuckoo.SLOTS)
    wrong = {found["wrong"][at : at + 16] for at in range(0, len(found["wrong"]), 16)}
    held = cuckoo.Shards(0, slots, np.zeros(1, np.int64), np.array([len(slots) - 1], np.uint64)).holds(*keys.view(np.uint64).T)
    assert len(wrong) > 100
    for key, common, hit in zip(keys, docs >= 10, held):
        assert (hit and key.tobytes() not in wrong) == common


def test_filter_puts_and_takes_by_arrays():
    draw = np.random.default_rng(3)
    keys = draw.integers(0, 2**63, (30_000, 2)).astype(np.uint64)
    slots = cuckoo.built(keys[:, 0], keys[:, 1])

    def held(some):
        return cuckoo.Shards(0, slots, np.zeros(1, np.int64), np.array([len(slots) - 1], np.uint64)).holds(some[:, 0], some[:, 1])

    assert held(keys).all()
    assert held(draw.integers(0, 2**63, (30_000, 2)).astype(np.uint64)).mean() < 1e-3
    cuckoo.take(slots, keys[:10_000, 0], keys[:10_000, 1])
    assert held(keys[10_000:]).all()
    assert not held(keys[:10_000]).any()
    cuckoo.put(slots, keys[:5_000, 0], keys[:5_000, 1])
    assert held(keys[:5_000]).all()
    with pytest.raises(KeyError):
        cuckoo.take(slots, keys[5_000:5_001, 0], keys[5_000:5_001, 1])
    cuckoo.take(slots, np.concatenate((keys[:5_000, 0], keys[10_000:, 0])), np.concatenate((keys[:5_000, 1], keys[10_000:, 1])))
    assert not slots.any()
    with pytest.raises(cuckoo.Full):
        cuckoo.put(np.zeros((16, cuckoo.SLOTS), np.uint32), keys[:200, 0], keys[:200, 1])
