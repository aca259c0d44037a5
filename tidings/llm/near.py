"""Near-duplicates by bottom-k sketches, and the components they form.

A text is the set of its different five-word shingles (fewer words: all of them as
one), as 64-bit hashes. Texts of equal sets are one class from the start. From ``GROUPED`` percent on a class retains its values in the order of one hash function, cut into groups by ranges of
the hash space. There are more groups than values in which similar sets can differ, so two such sets share a whole
group, and nothing is lost; texts that share a few shingles seldom share a group. For lower thresholds a class
retains the k first values of its set, where k is its size less the least overlap that
a similar set must have, plus one: any two sets that are similar enough share a retained
value. Values that many classes retain come last there, so that common passages
seldom bring classes together.

The inverted lists of what is retained bring candidates. From every list each class is
first paired with the list's pivot only, so pairs grow with the lists' lengths. The pivot is the
member that is in the most lists: it differs least from the others, so it links most of a family.
After the components of verified links are known, only pairs of different components are
left: those of a list's members outside its largest component, of all of them in short lists, and in
long ones of some a round, until no list has an undecided pair. A pair is dropped where it meets if its sizes exclude it, or a bitmap
of each set does: 1024 parities, which differ in no more places than the sets do, so that no similar pair is
lost, while families of texts just below the threshold lose nearly all of theirs, before a row is made. Bitmaps are moved
by class in the first round, and only with the members of open lists later. Then it is dropped if the estimate from
the union of both bottom-k sketches is far below, with ``estimate``, and verified on the full sets. The estimate may be
6.5 standard deviations off; without it nothing is left to chance.

Nulls, empty texts and texts without words have no shingles and link with nothing. Equal
texts are linked. Rows of equal ids are one document with the union of their links; its size
is that of the largest. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.components import components
from tidings.llm.words import STEP, Words, distinct, fresh, give_back, mix, sequences, slices, words
from tidings.plans import Workspace

SHINGLE = 5
SKETCH = 64
#: A value that more classes retain comes last.
OFTEN = 128
#: A list longer than this is long.
LONG = 2048
#: Pivots that a long list takes a round.
PIVOTS = 2048
#: 64-bit words of a set's bitmap. Its parities tell sets of up to about 600 values just below the threshold from similar ones.
BITMAP = 16
#: A class's first values, by which a pair that meets in many lists counts in the first of them.
HEAD = 8
#: Values that come last; the commonest ones if there are more.
COMMON = 2_000_000
#: The least similarity in percent for which sets are retained in groups.
GROUPED = 70
SEGMENT_BYTES = 24_000_000
#: How many standard deviations an estimate may be below the threshold.
SLACK = 6.5


def shingles(column: pa.Array) -> Words:
    """Each text's set as ascending hashes."""
    return distinct(sequences(words(column), SHINGLE))


def _two(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set; empty sets get zeros."""
    size = found.counts
    with np.errstate(over="ignore"):
        sums = [np.zeros(len(found.values) + 1, np.uint64) for _ in range(2)]
        for at, total in enumerate(sums):
            np.cumsum(mix(found.values + np.uint64(at * 2 + 1) * np.uint64(0x94D049BB133111EB)), out=total[1:])
        return tuple(mix(total[found.first[1:]] - total[found.first[:-1]] + size.astype(np.uint64)) for total in sums)


def retained(found: Words, percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of what each set retains for similarities of ``percent`` or more."""
    size = found.counts
    keep = np.where(size > 0, size - -(-percent * size // 100) + 1, 0)
    owner, values = found.owner, found.values
    if len(common):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        last = common[at] == values
        order = np.lexsort((values, last, owner))
        owner, values = owner[order], values[order]
    rank = np.arange(len(values)) - found.first[:-1][owner]
    kept = rank < keep[owner]
    return owner[kept], values[kept]


def bitmaps(found: Words) -> list[np.ndarray]:
    """For each set ``BITMAP`` words of parities: how many of its values fall to a bit, odd or even."""
    words = [np.zeros(len(found.first) - 1, np.uint64) for _ in range(BITMAP)]
    some = np.flatnonzero(found.counts > 0)
    if len(some):
        spread = mix(found.values ^ np.uint64(0x2545F4914F6CDD1D))
        bit, word = np.uint64(1) << (spread & np.uint64(63)), (spread >> np.uint64(6)) % np.uint64(BITMAP)
        for at, held in enumerate(words):
            held[some] = np.bitwise_xor.reduceat(np.where(word == at, bit, np.uint64(0)), found.first[:-1][some])
    return words


def _bits(letter: str) -> list[str]:
    return [f"{letter}{at}" for at in range(BITMAP)]


def _pack(spread: np.ndarray, segments: int, **columns: np.ndarray) -> dict[str, list]:
    """Rows of segments of the hash space by ``spread``, with each column's numbers."""
    of = ((spread >> np.uint64(40)).astype(np.int64) * segments) >> 24
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(segments + 1))
    used = np.flatnonzero(np.diff(bounds))
    cut = [order[bounds[one] : bounds[one + 1]] for one in used]
    return {"segment": used.tolist(), **{name: [values[x].tobytes() for x in cut] for name, values in columns.items()}}


def _merged(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(raw, "<u8") for raw in table[name].to_pylist()] or [np.zeros(0, np.uint64)])


def _new(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the sorted pairs differ from the one before."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (keys[1:] != keys[:-1])
    return new


class Parts(NamedTuple):
    """How sets are cut into parts, by level of size: each level's first size, its number of parts, its least group."""

    first: np.ndarray
    parts: np.ndarray
    least: np.ndarray


def _differ(percent: int, size, most):
    """The most values in which a set of ``size`` differs from a similar one of ``most`` values or fewer."""
    return (size + np.minimum(most, 100 * size // percent)) * (100 - percent) // (100 + percent)


def _groups(size: int, parts: int, least: int) -> float:
    """Parts of a set, less two standard deviations, that can be expected to hold ``least`` (1 or 2) values."""
    out = 1 - 1 / parts
    held = 1 - out**size - (size / parts * out ** (size - 1) if least == 2 else 0)
    return parts * held - 2 * (parts * max(held * (1 - held), 0)) ** 0.5


def parts(percent: int) -> Parts:
    """A similar set is of the same level of size or the next, or the one before."""
    first = [1]
    while first[-1] < 1 << 40:
        first.append(100 * first[-1] // percent + 1)
    cuts = []
    for low, after in zip(first, first[1:]):
        most = after - 1
        fewest = int(_differ(percent, most, most)) + 1
        sizes = {max(1, -(-one * percent // 100)) for one in (low, (low + most) // 2, most)} | {low, most}
        for least, limit in ((2, 1.3), (1, 1.5)):
            cut = fewest
            while cut <= limit * fewest + 4 and any(_groups(one, cut, least) <= _differ(percent, one, most) for one in sizes):
                cut += 1 + cut // 50
            if cut <= limit * fewest + 4:
                break
        cuts.append((cut, least))
    return Parts(np.array(first[:-1]), *(np.array(one) for one in zip(*cuts)))


def grouped(found: Words, percent: int, by: Parts) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the groups that each set retains for similarities of ``percent`` or more.

    A set is cut into the parts of its own level, and into those of the next one, whose sets may be similar. Values that
    are in one of two similar sets only fall to fewer parts than a set has groups of ``least`` values, so that one
    group at least is the same in both. A set with too few of them retains all its parts, empty ones too.
    """
    size = found.counts
    level = np.searchsorted(by.first, size, side="right") - 1
    owners, hashes = [], []
    with np.errstate(over="ignore"):
        sums = np.zeros(len(found.values) + 1, np.uint64)
        np.cumsum(mix(found.values + np.uint64(5 * STEP & (1 << 64) - 1)), out=sums[1:])
        for step in (0, 1):
            at = np.minimum(level + step, len(by.first) - 1)
            most = np.append(by.first, 1 << 62)[at + 1] - 1
            some = (size > 0) & ((100 * size // percent >= by.first[at]) | (step == 0))
            cut = np.where(some, by.parts[at], 0)
            start = np.concatenate(([0], np.cumsum(cut)))
            spread = cut[found.owner]
            inside = np.flatnonzero(spread)
            part = ((found.values[inside] >> np.uint64(32)) * spread[inside].astype(np.uint64)) >> np.uint64(32)
            # Values ascend, so a part's are side by side.
            place = start[:-1][found.owner[inside]] + part.astype(np.int64)
            head = np.flatnonzero(np.diff(place, prepend=-1))
            tail = np.append(head[1:], len(place))
            held = np.zeros(start[-1], np.int64)
            total = np.zeros(start[-1], np.uint64)
            if len(head):
                held[place[head]] = tail - head
                total[place[head]] = sums[inside[tail - 1] + 1] - sums[inside[head]]
            owner = np.repeat(np.arange(len(size)), cut)
            large = held >= by.least[at][owner]
            enough = np.bincount(owner[large], minlength=len(size)) > _differ(percent, size, most)
            kept = np.flatnonzero(large | ~enough[owner])
            owner = owner[kept]
            number = (kept - start[:-1][owner]).astype(np.uint64) << np.uint64(8) | at[owner].astype(np.uint64)
            owners.append(owner)
            hashes.append(mix(total[kept] + mix(number + np.uint64(1)) + held[kept].astype(np.uint64)))
    return np.concatenate(owners), np.concatenate(hashes)


class _Run:
    """One search; holds its tables in ``room``."""

    def __init__(self, docs: DataFrame, percent: int, room: Workspace):
        self.spark, self.percent, self.room = docs.sparkSession, percent, room
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        size = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.segments = max(1, -(-size // SEGMENT_BYTES))
        self.parts = parts(percent) if GROUPED <= percent < 100 else None

    def keys(self) -> DataFrame:
        """doc_id, size, the set's two hashes, its sketch and its bitmap of every row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in batches:
                for one in slices(batch, "text"):
                    found = shingles(one.column("text"))
                    first, second = _two(found)
                    sketches = [found.values[a : min(b, a + SKETCH)].tobytes() for a, b in zip(found.first[:-1], found.first[1:])]
                    columns = [
                        one.column("doc_id"),
                        pa.array(found.counts, pa.int64()),
                        pa.array(first.view(np.int64)),
                        pa.array(second.view(np.int64)),
                        pa.array(sketches, pa.binary()),
                        *(pa.array(word.view(np.int64)) for word in bitmaps(found)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "key", "check", "sketch", *_bits("x")])

        words = ", ".join(f"{name} long" for name in _bits("x"))
        return self.docs.mapInArrow(run, f"doc_id long, n long, key long, check long, sketch binary, {words}")

    def _retained(self, pack, common: np.ndarray) -> DataFrame:
        """Segments of what is retained; of equal sets that lie near each other one counts."""
        sent = self.spark.sparkContext.broadcast(common)
        percent, by = self.percent, self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in batches:
                for one in slices(batch, "text", 8_000_000):
                    held_values, held_keys = [], []
                    for part in slices(one, "text"):
                        found = shingles(part.column("text"))
                        key, _ = _two(found)
                        owner, values = grouped(found, percent, by) if by else retained(found, percent, sent.value)
                        held_values.append(values)
                        held_keys.append(key[owner])
                    values, keys = np.concatenate(held_values), np.concatenate(held_keys)
                    order = np.lexsort((keys, values))
                    values, keys = values[order], keys[order]
                    new = _new(values, keys)
                    for rows in pack(values[new], keys[new], sent.value):
                        yield pa.RecordBatch.from_pydict(
                            rows, pa.schema({"segment": pa.int32(), "at": pa.binary(), "more": pa.binary()})
                        )

        return self.docs.mapInArrow(run, "segment int, at binary, more binary")

    def common(self) -> np.ndarray:
        """The values, at most COMMON, that the most classes retain; none for groups, which have no order."""
        segments = self.segments
        if self.parts:
            return np.zeros(0, np.uint64)

        def pack(values: np.ndarray, keys: np.ndarray, common: np.ndarray) -> Iterator[dict]:
            different, counts = np.unique(values, return_counts=True)
            yield _pack(different, segments, at=different, more=counts.astype("<u8"))

        def tally(key: tuple, table: pa.Table) -> pa.Table:
            values, counts = _merged(table, "at"), _merged(table, "more")
            different, back = np.unique(values, return_inverse=True)
            counts = np.bincount(back, weights=counts).astype(np.int64)
            often = counts > OFTEN
            return pa.table({"value": pa.array(different[often].view(np.int64)), "n": pa.array(counts[often], pa.int64())})

        found = self._retained(pack, np.zeros(0, np.uint64)).groupBy("segment").applyInArrow(tally, "value long, n long")
        held = self.room.hold(found, "common")
        steps = held.groupBy(F.floor(F.log2("n")).alias("step")).agg(F.count("*").alias("values")).collect()
        room, least = COMMON, 63
        for row in sorted(steps, key=lambda row: -row.step):
            if row["values"] > room:
                break
            room, least = room - row["values"], row.step
        chosen = held.where(F.floor(F.log2("n")) >= least).select("value").toArrow()
        return np.sort(chosen["value"].to_numpy().view(np.uint64))

    def members(self, common: np.ndarray) -> DataFrame:
        """value and key for each value that several classes retain.

        Rare values meet in segments of the values' hash space. Common ones are spread by the
        classes' hashes instead, so a value that a third of all classes retain isn't gathered.
        """
        segments = self.segments

        def pack(values: np.ndarray, keys: np.ndarray, common: np.ndarray) -> Iterator[dict]:
            often = np.isin(values, common)
            yield _pack(values[~often], segments, at=values[~often], more=keys[~often])
            rows = _pack(keys[often], segments, at=values[often], more=keys[often])
            yield rows | {"segment": [segments + one for one in rows["segment"]]}

        def shared(key: tuple, table: pa.Table) -> pa.Table:
            values, keys = _merged(table, "at"), _merged(table, "more")
            order = np.lexsort((keys, values))
            values, keys = values[order], keys[order]
            new = _new(values, keys)
            values, keys = values[new], keys[new]
            kept = np.full(len(values), key[0].as_py() >= segments)
            same = values[1:] == values[:-1]
            kept[1:] |= same
            kept[:-1] |= same
            return pa.table({"value": pa.array(values[kept].view(np.int64)), "key": pa.array(keys[kept].view(np.int64))})

        return self._retained(pack, common).groupBy("segment").applyInArrow(shared, "value long, key long")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """key and full set of the classes in ``wanted`` (doc_id, key)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in batches:
                for one in slices(batch, "text"):
                    found = shingles(one.column("text"))
                    key, _ = _two(found)
                    same = pa.array(key.view(np.int64) == one.column("key").to_numpy())
                    cut = [found.values[a:b].tobytes() for a, b in zip(found.first[:-1], found.first[1:])]
                    columns = [one.column("key"), pa.array(cut, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "full"]).filter(same)

        wanted = wanted.select(F.col("doc_id").alias("_id"), "key")
        if wanted.count() * 16 <= 32 << 20:
            wanted = F.broadcast(wanted)
        rows = self.docs.join(wanted, F.col("doc_id") == F.col("_id")).select("key", "text")
        return rows.mapInArrow(run, "key long, full binary")


def _few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _estimated(percent: int):
    """Keep pairs whose union sketch doesn't speak clearly against them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in _few(batches):
            kept = []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                a, b = np.frombuffer(left, "<u8"), np.frombuffer(right, "<u8")
                k = max(1, min(max(len(a), len(b)), SKETCH))
                union = np.union1d(a, b)[:k]
                share = np.isin(union, np.intersect1d(a, b, assume_unique=True)).sum() / k
                wanted = percent / 100
                kept.append(len(a) < SKETCH or len(b) < SKETCH or share >= wanted - SLACK * (wanted * (1 - wanted) / k) ** 0.5)
            yield batch.filter(pa.array(kept, pa.bool_())).select(["a", "b"])

    return run


def _verified(percent: int):
    """Mark pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in _few(batches):
            linked = []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                a, b = np.frombuffer(left, "<u8"), np.frombuffer(right, "<u8")
                both = np.concatenate((a, b))
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                linked.append(100 * same >= percent * (len(both) - same))
            yield batch.filter(pa.array(linked, pa.bool_())).select(["a", "b"])

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()


def _with_sets(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Pairs with both classes' sets; only the sets asked for are moved."""
    sets = sets.join(_ends(pairs), "key", "left_semi")
    left = sets.select(F.col("key").alias("a"), F.col(column).alias("left"))
    right = sets.select(F.col("key").alias("b"), F.col(column).alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")


def classes(docs: DataFrame, percent: int = 85, room: Workspace | None = None, estimate: bool = True) -> DataFrame:
    """A row per different id: doc_id, n_shingles, component_id, kept, n_rows.

    Documents are linked if 100 * common >= percent * union of their shingles. The
    component is named by its least id; that document is the one to keep. Without ``estimate`` every
    pair that sizes and bitmaps allow is verified.
    """
    room = room or Workspace(docs.sparkSession)
    run = _Run(docs, percent, room)
    keys = room.hold(run.keys(), "keys")
    full = keys.where("n > 0 AND doc_id IS NOT NULL").drop("sketch")
    first = [F.min("doc_id").alias("rep"), *(F.min(name).alias(name) for name in _bits("x"))]
    classed = room.hold(full.groupBy("key", "check", "n").agg(*first), "classes")
    members = _different(room.hold(run.members(run.common()), "members"))
    links = _links(run, keys, classed, members, room, estimate)
    return _result(keys, full, classed, links, room)


def _different(members: DataFrame) -> DataFrame:
    """The members of one of the lists that hold the same classes: copies that differ little share most of their groups."""
    held = [F.bit_xor(F.xxhash64("key")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("other"), F.count("*").alias("size")]
    lists = members.groupBy("value").agg(*held).where("size > 1")
    return members.join(lists.groupBy("one", "other", "size").agg(F.min("value").alias("value")), "value", "left_semi")


def _sizes_allow(percent: int):
    """Whether two classes' sizes, ``n`` and ``m``, allow a link."""
    return 100 * F.least("n", "m") >= percent * F.greatest("n", "m")


def _bitmaps_allow(percent: int):
    """Whether two classes' bitmaps allow a link; ``n`` and ``x`` are of one, ``m`` and ``y`` of the other.

    Sets that differ in d values have bitmaps that differ in d places at most, and share (n + m - d) / 2.
    """
    n, m = F.col("n"), F.col("m")
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(_bits("x"), _bits("y"))), F.lit(0))
    return (100 + percent) * (n + m - differ) >= 2 * percent * (n + m)


def _other(columns: dict[str, str]) -> list:
    """A class's columns as those of the other one of a pair."""
    renamed = {"key": "a", "n": "m", **dict(zip(_bits("x"), _bits("y"))), **columns}
    return [F.col(name).alias(other) for name, other in renamed.items()]


def _links(run: _Run, keys: DataFrame, classed: DataFrame, members: DataFrame, room: Workspace, estimate: bool) -> DataFrame:
    """Links between classes that leave the components of all links, round by round."""
    name = uuid.uuid4().hex[:8]
    percent = run.percent
    lists = members.groupBy("key").agg(F.count("*").alias("lists"))
    candidates = lists.join(classed, "key").select(F.col("rep").alias("doc_id"), "key", "n", "lists", *_bits("x"))
    candidates = room.hold(candidates, f"candidates-{name}")
    sketches = room.hold(keys.select("doc_id", "key", "sketch").join(candidates, ["doc_id", "key"], "left_semi"), f"sketches-{name}")
    sets = None
    sized = room.hold(members.join(candidates.select("key", "n", "lists"), "key"), f"sized-{name}")
    pivots = sized.groupBy("value").agg(F.max(F.struct("lists", "key", "n")).alias("p")).select("value", F.col("p.key").alias("a"), F.col("p.n").alias("m"))
    pairs = sized.join(pivots, "value").where(_sizes_allow(percent) & (F.col("key") != F.col("a"))).select("a", F.col("key").alias("b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    bits = candidates.select("key", "n", *_bits("x"))
    pairs = pairs.join(bits.withColumnRenamed("key", "b"), "b").join(bits.select(*_other({})), "a")
    pairs = room.hold(pairs.where(_bitmaps_allow(percent)).select("a", "b"), f"pairs-{name}")
    used = pivots.select("value", F.col("a").alias("key"))
    links, decided, last, number = None, None, False, 0
    while True:
        number += 1
        near = pairs.select("a", "b")
        if estimate:
            near = room.hold(_with_sets(pairs, sketches, "sketch").mapInArrow(_estimated(percent), "a long, b long"), f"near-{name}-{number}")
        wanted = candidates.join(_ends(near), "key", "left_semi")
        wanted = wanted if sets is None else wanted.join(sets, "key", "left_anti")
        found_sets = room.hold(run.sets(room.hold(wanted, f"wanted-{name}-{number}")), f"sets-{name}-{number}")
        sets = found_sets if sets is None else sets.unionByName(found_sets)
        found = _with_sets(near, sets, "full").mapInArrow(_verified(percent), "a long, b long")
        found = room.hold(found, f"found-{name}-{number}")
        links = found if links is None else links.unionByName(found)
        if last:
            return links
        decided = pairs if decided is None else decided.unionByName(pairs)
        roots = room.hold(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), room), f"roots-{name}-{number}")
        pairs, used, last = _left(sized, bits, used, roots, decided, percent, room, f"{name}-{number}")
        if last and pairs.isEmpty():
            return links


def _left(sized: DataFrame, bits: DataFrame, used: DataFrame, roots: DataFrame, decided: DataFrame, percent: int, room: Workspace, name: str):
    """The next round's pairs of different components, the pivots till then, and whether that decides every list."""
    placed = sized.join(roots, sized["key"] == roots["u"], "left").select("value", "key", "lists", F.coalesce("root", "key").alias("root"))
    by_root = placed.groupBy("value", "root").agg(F.count("*").alias("weight"))
    most = F.max(F.struct("weight", "root")).alias("most")
    lists = by_root.groupBy("value").agg(most, F.sum("weight").alias("size")).where("most.weight < size")
    open_ = room.hold(placed.join(lists.select("value", F.col("most.root").alias("largest"), "size"), "value"), f"open-{name}")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("value"))
    first = open_.select("key", "value").withColumn("rank", rank).where(F.col("rank") <= HEAD)
    head = first.groupBy("key").agg(F.collect_list("value").alias("head"))
    placed = room.hold(open_.join(head.join(bits, "key"), "key"), f"placed-{name}")
    # Members outside a list's largest component are the next pivots. Two undecided members of
    # the largest are linked already, so a list is decided once it has no other.
    outside = room.hold(placed.where("root <> largest").join(used, ["value", "key"], "left_anti"), f"outside-{name}")
    long = outside.where(F.col("size") > LONG)
    last = long.groupBy("value").count().where(F.col("count") > PIVOTS).isEmpty()
    turn = outside
    if not last:
        order = Window.partitionBy("value").orderBy(F.desc("lists"), "key")
        some = long.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= PIVOTS).drop("turn")
        turn = room.hold(outside.where(F.col("size") <= LONG).unionByName(some), f"turn-{name}")
    others = turn.select("value", *_other({"root": "other", "head": "heads"}))
    apart = (F.col("root") != F.col("other")) & _sizes_allow(percent) & _bitmaps_allow(percent)
    # Most pairs share one of their first values; they count where they meet first.
    apart &= ~F.exists(F.array_intersect("head", "heads"), lambda one: one < F.col("value"))
    pairs = placed.join(others, "value").where(apart).select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b")).distinct()
    pairs = room.hold(pairs.join(decided, ["a", "b"], "left_anti"), f"next-{name}")
    return pairs, used.unionByName(turn.select("value", "key")), last


def _result(keys: DataFrame, full: DataFrame, classed: DataFrame, links: DataFrame, room: Workspace) -> DataFrame:
    """Components over documents: links between classes' first documents, and of each document to its class's."""
    reps = classed.select("key", "rep")
    of_classes = (
        links.join(reps.select(F.col("key").alias("a"), F.col("rep").alias("u")), "a")
        .join(reps.select(F.col("key").alias("b"), F.col("rep").alias("v")), "b")
        .select("u", "v")
    )
    belongs = room.hold(full.join(classed, ["key", "check", "n"]).select("doc_id", "rep"), "belongs")
    ids = belongs.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    of_ids = belongs.join(ids.where("low <> high"), "doc_id").select(F.col("rep").alias("u"), F.col("low").alias("v"))
    roots = components(of_classes.unionByName(of_ids), room)
    sizes = keys.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.count("*").alias("n_rows"))
    rows = sizes.join(ids.select("doc_id", "low"), "doc_id", "left")
    found = rows.join(roots, rows["low"] == roots["u"], "left").withColumn("component_id", F.coalesce("root", "low", "doc_id"))
    kept = F.col("component_id").eqNullSafe(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "n_rows")


def firsts(docs: DataFrame, percent: int = 80, room: Workspace | None = None) -> DataFrame:
    """One document of each component, with all its columns.

    Of rows with one id the one of the least text stays. Rows without an id all stay.
    """
    room = room or Workspace(docs.sparkSession)
    found = room.hold(classes(docs, percent, room), "found").where("doc_id IS NOT NULL")
    own = fresh("_id", docs.columns)
    gone = found.where("NOT kept OR n_rows > 1").select(F.col("doc_id").alias(own))
    several = found.where("kept AND n_rows > 1").select(F.col("doc_id").alias(own))
    gone, several = (F.broadcast(ids) if ids.count() * 16 <= 32 << 20 else ids for ids in (gone, several))
    same = docs["doc_id"].cast("long") == F.col(own)
    single = docs.join(gone, same, "left_anti")
    chosen = (
        docs.join(several, same)
        .groupBy(own)
        .agg(F.min_by(F.struct(*(F.col(f"`{name}`") for name in docs.columns)), F.coalesce("text", F.lit(""))).alias("row"))
    )
    return single.unionByName(chosen.select("row.*"))
