"""Log-probabilities of texts under a bigram model in log-frequency Bloom filters.

Counting. All words and pairs of neighbouring words of all training texts are counted, packed as arrays
of hashes by segments of the hash space: a task sums its own first, segments are merged apart, and
the number of segments follows the corpus, so that a segment's size doesn't.

Model. A pair's count c is held as its quantised level 1 + floor(log(c) / log(base)): a segment's
filter has the pair with every level up to its own, and probing level after level until one is
missing gives the level back. What is read is the least count of the level, so it is never above c. The
pair's probability is smoothed towards the word's: (least(v, w) + mu * p(w)) / (count(v) + mu), with
mu a documented constant and p(w) = (count(w) + 1) / (N + V + 1) rounded down to a step of 1/4096 of a
decade. Counts of single words are exact, 0 for words that training lacks. So no probability exceeds 1, and
the probabilities of what may follow a word sum to at most 1, but for the filter's errors: of the pairs that
weren't seen, of words that were, it takes one in 500 for one that was seen once.

Scoring. One pass over the texts, whatever the size of the model. A task takes texts up to a million
tokens, adds up what follows from words alone, and sends the pairs to the segments, a row for each segment:
five bytes of hash, the word's quantised probability and the text's place. There they meet the segment's
filter, and what pairs gain goes back as one sum for each text. Filters don't pass through the driver. Word
counts come from the broadcast ``head`` of the commonest words, at most that many, and for rarer
words by a shuffle of those words alone: ``head`` decides where a count is looked up and not what it is.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased; each text ends with
an end token. Very long texts are read in windows. Nulls: a null text is empty and has only the end token. Equal
rows are scored each, equal ids as well. Other columns are ignored. An empty training table
gives every token the probability 1 / (0 + 0 + 1).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.words import SLICE_BYTES, Words, mix, numbers, slices, texts, windows, words
from tidings.plans import Workspace

END, START = numbers(2, 91)
BASE = 1.5
#: Bits that a level of a pair sets, all in one block of 128, and bits of a filter for each: an error in 500.
BITS, ROOM = 8, 16
#: What a word's own probability weighs against the pairs that follow the word before it.
MU = 16.0
#: Steps of a decade in which words' probabilities are held.
STEPS = 4096
SEGMENT_BYTES = 16_000_000
FLUSH = 2_000_000
#: Tokens and texts that are sent together.
CHUNK_TOKENS = 1_000_000
CHUNK_ROWS = 60_000
LOW = np.uint64((1 << 40) - 1)
PACKED = "kind int, segment int, at binary, counts binary"


class Block(NamedTuple):
    """Tokens of some texts, or of a part of one: rows, and the token before each row's first."""

    rows: np.ndarray
    found: Words
    before: np.ndarray


def blocks(column: pa.Array) -> Iterator[Block]:
    """The tokens of each text with its end token; a very long text comes in several blocks."""
    _, ends = texts(column)
    if ends[-1] <= 2 * SLICE_BYTES:
        found = words(column)
        first = found.first + np.arange(len(found.first))
        yield Block(np.arange(len(column)), Words(np.insert(found.values, found.first[1:], END), first), np.full(len(column), START))
        return
    for row in range(len(column)):
        last = START
        for _, part in windows(column.slice(row, 1)):
            values = words(part).values
            if len(values):
                yield Block(np.array([row]), Words(values, np.array([0, len(values)])), np.array([last]))
                last = values[-1]
        yield Block(np.array([row]), Words(np.array([END]), np.array([0, 1])), np.array([last]))


def contexts(block: Block) -> np.ndarray:
    """For each token the one before."""
    before = np.concatenate(([START], block.found.values[:-1]))
    starts = block.found.first[:-1]
    before[starts[np.diff(block.found.first) > 0]] = block.before[np.diff(block.found.first) > 0]
    return before


def pairs(before: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of neighbours."""
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(0xD6E8FEB86659FD93) + values)


def _binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([part.tobytes() for part in parts], pa.binary())


def _narrow(keys: np.ndarray) -> np.ndarray:
    """The low 40 bits of pairs, in five bytes each; the others name the segment."""
    low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4").view(np.uint8)
    return np.concatenate((low, ((keys >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)))


def _wide(raw: bytes) -> np.ndarray:
    size = len(raw) // 5
    low = np.frombuffer(raw, "<u4", size).astype(np.uint64)
    return low | np.frombuffer(raw, np.uint8, size, 4 * size).astype(np.uint64) << np.uint64(32)


def _few(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte each if they fit, else in four."""
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else "<u4")


def _counts(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == size else "<u4").astype(np.int64)


def _summed(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different values in ascending order and how often they come."""
    if counts is None:
        return np.unique(values, return_counts=True)
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    heads = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _segment(values: np.ndarray, segments: int) -> np.ndarray:
    return ((values >> np.uint64(40)).astype(np.int64) * segments) >> 24


def _cut(values: np.ndarray, segments: int) -> tuple[np.ndarray, list[slice]]:
    """The segments of ascending values, and where each lies."""
    bounds = np.searchsorted(_segment(values, segments), np.arange(segments + 1))
    used = np.flatnonzero(np.diff(bounds))
    return used, [slice(bounds[one], bounds[one + 1]) for one in used]


def _pack(kind: int, values: np.ndarray, counts: np.ndarray, segments: int) -> pa.RecordBatch:
    """A row per segment with the values, ascending, and counts of it."""
    used, cut = _cut(values, segments)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(used), kind), pa.int32()),
            pa.array(used, pa.int32()),
            _binary([_narrow(values[one]) if kind else values[one] for one in cut]),
            _binary([_few(counts[one]) for one in cut]),
        ],
        ["kind", "segment", "at", "counts"],
    )


def _count(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                if held[kind]:
                    values, counts = _summed(np.concatenate(held[kind]))
                    held[kind].clear()
                    yield _pack(kind, values, counts, segments)

        for batch in batches:
            for one in slices(batch, "text"):
                for block in blocks(one.column("text")):
                    held[0].append(block.found.values)
                    held[1].append(pairs(contexts(block), block.found.values))
                    if sum(map(len, held[0])) > FLUSH:
                        yield from flush()
        yield from flush()

    return run


def _spots(values: np.ndarray, level: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value and the level its block, and the bits that it sets in the block's two words."""
    with np.errstate(over="ignore"):
        one = mix(values + np.uint64(level) * np.uint64(0xC2B2AE3D27D4EB4F))
    chosen = mix(one)
    words = [np.zeros(len(values), np.uint64) for _ in range(2)]
    for at in range(BITS):
        words[at % 2] |= np.uint64(1) << ((chosen >> np.uint64(6 * at)) & np.uint64(63))
    return ((one >> np.uint64(16)) % np.uint64(blocks)).astype(np.int64), *words


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised level of each count of 1 or more."""
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def level_least() -> np.ndarray:
    """The least count of each level; 0 at level 0."""
    return np.concatenate(([0.0], np.ceil(BASE ** np.arange(0, 110) - 1e-6)))


def build_filter(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Blocks of two words, with room for every value and level."""
    of = levels(counts)
    blocks = max(4, int(of.sum()) * ROOM // 128)
    filter_ = np.zeros((blocks, 2), np.uint64)
    for level in range(1, int(of.max(initial=0)) + 1):
        block, *words = _spots(values[of >= level], level, blocks)
        order = np.argsort(block, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], np.diff(block[order]) != 0)))
        for at, word in enumerate(words):
            filter_[block[order][heads], at] |= np.bitwise_or.reduceat(word[order], heads)
    return filter_


def probe(filter_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The level of each value, 0 if it isn't there."""
    found, left, level = np.zeros(len(values), np.int64), np.arange(len(values)), 1
    while len(left):
        block, first, second = _spots(values[left], level, len(filter_))
        held = filter_[block]
        left = left[((held[:, 0] & first) == first) & ((held[:, 1] & second) == second)]
        found[left] = level
        level += 1
    return found


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    """Sum a segment; words stay as arrays, pairs become a filter."""
    kind = key[0].as_py()
    parts = [np.frombuffer(raw, "<u8") if kind == 0 else _wide(raw) for raw in table["at"].to_pylist()]
    counts = [_counts(raw, len(part)) for raw, part in zip(table["counts"].to_pylist(), parts)]
    values, counts = _summed(np.concatenate(parts), np.concatenate(counts))
    if kind == 0:
        size = np.floor(np.log2(counts)).astype(np.int64)
        by_size, totals = np.bincount(size, minlength=64), np.bincount(size, weights=counts, minlength=64)
        first, second = values.tobytes(), counts.astype("<i8").tobytes()
    else:
        by_size = totals = np.zeros(64)
        first, second = build_filter(values, counts).tobytes(), b""
    return pa.table(
        {
            "kind": pa.array([kind], pa.int32()),
            "segment": pa.array([key[1].as_py()], pa.int32()),
            "at": pa.array([first], pa.binary()),
            "counts": pa.array([second], pa.binary()),
            "words": pa.array([by_size.astype(np.int64).tolist()], pa.list_(pa.int64())),
            "tokens": pa.array([totals.astype(np.int64).tolist()], pa.list_(pa.int64())),
        }
    )


class Head(NamedTuple):
    """The commonest words' exact counts, ascending by hash, and the sums over all words and texts."""

    values: np.ndarray
    counts: np.ndarray
    tokens: int
    words: int
    texts: int

    @property
    def whole(self) -> bool:
        """Whether no word is missing, so that a word that isn't here was never seen."""
        return len(self.values) == self.words

    def of(self, values: np.ndarray) -> np.ndarray:
        """Exact counts of head words and of the start; of others 0 if all are here, else -1."""
        at = np.minimum(np.searchsorted(self.values, values), max(len(self.values) - 1, 0))
        other = 0 if self.whole else -1
        found = np.where(self.values[at] == values, self.counts[at], other) if len(self.values) else np.full(len(values), other)
        return np.where(values == START, self.texts, found)

    def steps(self, counts: np.ndarray) -> np.ndarray:
        """Words' probabilities as steps below 1, rounded down."""
        return np.ceil(-np.log10((counts + 1) / (self.tokens + self.words + 1)) * STEPS - 1e-6).astype(np.int64)


class Statistics(NamedTuple):
    """Where the counts are held, and the bounded part of them."""

    table: DataFrame
    head: Head
    segments: int


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def count(train: DataFrame, room: Workspace, head: int = 2_000_000) -> Statistics:
    """Count words and pairs of all training texts and hold them in ``room``."""
    train = _texts(train)
    size = train.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("texts")).first()
    segments = max(1, -(-(size.bytes or 0) // SEGMENT_BYTES))
    packed = train.mapInArrow(_count(segments), PACKED)
    schema = f"{PACKED}, words array<long>, tokens array<long>"
    table = room.hold(packed.groupBy("kind", "segment").applyInArrow(_merge, schema), "counts")
    sums = (
        table.where("kind = 0")
        .select(F.posexplode(F.arrays_zip("words", "tokens")).alias("size", "one"))
        .groupBy("size")
        .agg(F.sum("one.words").alias("words"), F.sum("one.tokens").alias("tokens"))
        .collect()
    )
    words_of, tokens_of = np.zeros(64, np.int64), np.zeros(64, np.int64)
    for row in sums:
        words_of[row["size"]], tokens_of[row["size"]] = row.words, row.tokens
    above = np.cumsum(words_of[::-1])[::-1]
    least = int(np.argmax(above <= head))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, counts in zip(batch.column("at").to_pylist(), batch.column("counts").to_pylist()):
                counts = np.frombuffer(counts, "<i8")
                kept = counts >= 1 << least
                yield pa.RecordBatch.from_arrays(
                    [_binary([np.frombuffer(at, "<u8")[kept]]), _binary([counts[kept]])], ["at", "counts"]
                )

    common = table.where("kind = 0").select("at", "counts").mapInArrow(cut, "at binary, counts binary").toArrow()  # up to ``head``
    values, counts = (
        np.concatenate([np.frombuffer(raw, kind) for raw in common[name].to_pylist()] or [np.zeros(0, kind)])
        for name, kind in (("at", "<u8"), ("counts", "<i8"))
    )
    order = np.argsort(values)
    return Statistics(table, Head(values[order], counts[order], int(tokens_of.sum()), int(words_of.sum()), size.texts), segments)


#: What tasks send: the rows' own sums to any segment, pairs to the filters', rare words to the words'.
ROWS, PAIRS, RARE_PAIRS, RARE_WORDS, GAINS = range(5)
SENT = "segment int, kind int, chunk long, a binary, b binary, c binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(one), kind) for one, kind in zip(columns, kinds)], [name.split()[0] for name in SENT.split(", ")])


class _Chunk:
    """Texts that are sent together, and the sums that need no pair."""

    def __init__(self, head: Head, segments: int, mu: float):
        self.head, self.segments, self.mu = head, segments, mu
        self.begin(0)

    def begin(self, number: int) -> None:
        self.number, self.ids = number, []
        self.sums = np.zeros((4, CHUNK_ROWS))
        self.tokens = self.pending = 0
        self.near: list[tuple] = []
        self.rare: list[tuple] = []
        self.alone: list[tuple] = []

    def add(self, block: Block, base: int) -> None:
        head, values = self.head, block.found.values
        if not len(values):
            return
        rows = (base + block.rows)[block.found.owner].astype(np.uint16)
        before = contexts(block)
        different, back = np.unique(np.concatenate((values, block.before)), return_inverse=True)
        counts = head.of(different)[back]
        counts, starts = counts[: len(values)], counts[len(values) :]
        context = np.concatenate(([0], counts[:-1]))
        some = np.diff(block.found.first) > 0
        context[block.found.first[:-1][some]] = starts[some]
        far = counts < 0
        steps = head.steps(np.maximum(counts, 0))
        known = counts > 0
        own = np.where(far, 0, np.log10(self.mu) - steps / STEPS) - np.where(context < 0, 0, np.log10(np.maximum(context, 0) + self.mu))
        base_score = np.where(far, 0, np.log10(np.maximum(counts, 0) + 1.0))
        for at, one in enumerate((np.ones(len(values)), known, base_score, own)):
            self.sums[at] += np.bincount(rows, weights=one, minlength=CHUNK_ROWS)
        keys = pairs(before, values)
        seen = (context != 0) & known
        self.near.append((keys[seen], steps[seen].astype(np.uint16), rows[seen]))
        if far.any():
            rare = far & (context != 0)
            self.rare.append((keys[rare], values[rare], rows[rare]))
        if (far | (context < 0)).any():
            # A rare word counts as a token, and as what stands before the next one.
            both = np.concatenate((values[far], before[context < 0]))
            role = np.concatenate((np.zeros(far.sum(), np.uint8), np.ones((context < 0).sum(), np.uint8)))
            self.alone.append((both, role, np.concatenate((rows[far], rows[context < 0]))))
        self.tokens += len(values)
        self.pending += len(values)

    def pairs(self) -> Iterator[pa.RecordBatch]:
        """Send what waits for counts."""
        for kind, held in ((PAIRS, self.near), (RARE_PAIRS, self.rare), (RARE_WORDS, self.alone)):
            if held:
                keys, more, rows = (np.concatenate(one) for one in zip(*held))
                held.clear()
                order = np.argsort(keys, kind="stable")
                keys, more, rows = keys[order], more[order], rows[order]
                used, cut = _cut(keys, self.segments)
                if len(used):
                    yield _sent([
                        (segment, kind, self.number, (keys[one] if kind == RARE_WORDS else _narrow(keys[one])).tobytes(), more[one].tobytes(), rows[one].tobytes())
                        for segment, one in zip(used.tolist(), cut)
                    ])
        self.pending = 0

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self.pairs()
        if self.ids:
            size = len(self.ids)
            ids = np.array([one or 0 for one in self.ids], "<i8").tobytes() + np.array([one is None for one in self.ids], np.uint8).tobytes()
            counts = self.sums[:2, :size].astype("<i8").tobytes()
            yield _sent([(self.number % self.segments, ROWS, self.number, ids, counts, self.sums[2:, :size].tobytes())])
        self.begin(self.number + 1)


def _ask(head: Head, segments: int, mu: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = _Chunk(head, segments, mu)
    chunk.begin(TaskContext.get().partitionId() << 32)
    for batch in batches:
        for one in slices(batch, "text"):
            for at in range(0, one.num_rows, CHUNK_ROWS):
                some = one.slice(at, CHUNK_ROWS)
                if len(chunk.ids) + some.num_rows > CHUNK_ROWS:
                    yield from chunk.end()
                base = len(chunk.ids)
                chunk.ids += some.column("doc_id").to_pylist()
                for block in blocks(some.column("text")):
                    chunk.add(block, base)
                    if chunk.pending >= CHUNK_TOKENS:
                        yield from chunk.pairs()
                if chunk.tokens >= CHUNK_TOKENS:
                    yield from chunk.end()
    yield from chunk.end()


def _each(table: pa.Table) -> Iterator[dict]:
    """A table's rows, few at a time, as they hold long arrays."""
    for batch in table.to_batches(max_chunksize=16):
        yield from batch.to_pylist()


def _gains(mu: float, table: pa.Table, counted: pa.Table) -> pa.Table:
    """What a segment's pairs add to each text, and the levels of rare words' pairs; other rows go on."""
    filter_ = np.frombuffer(counted["at"][0].as_py(), "<u8").reshape(-1, 2) if len(counted) else None
    least = level_least()
    out = []
    for row in _each(table):
        if row["kind"] in (ROWS, RARE_WORDS):
            out.append(tuple(row.values()))
            continue
        level = probe(filter_, _wide(row["a"])) if filter_ is not None else np.zeros(len(row["a"]) // 5, np.int64)
        hit, rows = level > 0, np.frombuffer(row["c"], np.uint16)
        if row["kind"] == PAIRS:
            share = mu * 10.0 ** (-np.frombuffer(row["b"], np.uint16)[hit].astype(float) / STEPS)
            sums = np.bincount(rows[hit], weights=np.log10(1 + least[level[hit]] / share))
            used = np.flatnonzero(sums)
            out.append((row["segment"], GAINS, row["chunk"], used.astype(np.uint16).tobytes(), sums[used].tobytes(), b""))
        elif hit.any():
            word = np.frombuffer(row["b"], "<u8")[hit]
            out.append((-1, RARE_PAIRS, row["chunk"], word.tobytes(), level[hit].astype(np.uint8).tobytes(), rows[hit].tobytes()))
    return pa.Table.from_batches([_sent(out)]) if out else pa.table({name.split()[0]: [] for name in SENT.split(", ")}).cast(_sent([(0, 0, 0, b"", b"", b"")]).schema)


def _by_words(segments: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Send the levels of rare words' pairs on to the words' segments."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["kind"] == RARE_PAIRS:
                word = np.frombuffer(row["a"], "<u8")
                order = np.argsort(word, kind="stable")
                word, level, rows = word[order], np.frombuffer(row["b"], np.uint8)[order], np.frombuffer(row["c"], np.uint16)[order]
                for segment, one in zip(*_cut(word, segments)):
                    out.append((int(segment), RARE_PAIRS, row["chunk"], word[one].tobytes(), level[one].tobytes(), rows[one].tobytes()))
            else:
                out.append(tuple(row.values()))
        if out:
            yield _sent(out)


def _rare(head: Head, mu: float, table: pa.Table, counted: pa.Table) -> pa.Table:
    """What rare words add to each text by their counts."""
    values = np.frombuffer(counted["at"][0].as_py(), "<u8") if len(counted) else np.zeros(0, np.uint64)
    counts = np.frombuffer(counted["counts"][0].as_py(), "<i8") if len(counted) else np.zeros(0, np.int64)
    least = level_least()
    out = []
    for row in _each(table):
        word, more, rows = np.frombuffer(row["a"], "<u8"), np.frombuffer(row["b"], np.uint8), np.frombuffer(row["c"], np.uint16)
        at = np.minimum(np.searchsorted(values, word), max(len(values) - 1, 0))
        found = np.where(values[at] == word, counts[at], 0) if len(values) else np.zeros(len(word), np.int64)
        share = np.log10(mu) - head.steps(found) / STEPS
        if row["kind"] == RARE_PAIRS:
            gain = np.where(found > 0, np.log10(1 + least[more] / 10.0**share), 0.0)
            sums = np.stack((np.zeros(len(gain)), np.zeros(len(gain)), gain))
        else:
            token = more == 0
            sums = np.stack((token & (found > 0), np.where(token, np.log10(found + 1.0), 0), np.where(token, share, -np.log10(found + mu))))
        used, back = np.unique(rows, return_inverse=True)
        summed = np.stack([np.bincount(back, weights=one, minlength=len(used)) for one in sums])
        out.append((0, GAINS, row["chunk"], used.tobytes(), summed[2].tobytes(), summed[:2].tobytes()))
    return pa.Table.from_batches([_sent(out)])


SCORED = "doc_id long, n_tokens long, n_known long, base double, score double"


def _total(table: pa.Table) -> pa.Table:
    """The rows of a chunk with all that was found for them."""
    rows = table.to_pylist()
    own = next(row for row in rows if row["kind"] == ROWS)
    size = len(own["a"]) // 9
    ids, none = np.frombuffer(own["a"], "<i8", size), np.frombuffer(own["a"], np.uint8, size, 8 * size)
    tokens, known = np.frombuffer(own["b"], "<i8").reshape(2, size).copy()
    base, score = np.frombuffer(own["c"]).reshape(2, size).copy()
    for row in rows:
        if row["kind"] == GAINS:
            at = np.frombuffer(row["a"], np.uint16)
            score[at] += np.frombuffer(row["b"])
            if row["c"]:
                more = np.frombuffer(row["c"]).reshape(2, -1)
                known[at] += more[0].astype(np.int64)
                base[at] += more[1]
    return pa.table([pa.array(ids, mask=none.astype(bool)), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score)], [name.split()[0] for name in SCORED.split(", ")])


def score(docs: DataFrame, train: DataFrame, room: Workspace | None = None, mu: float = MU, head: int = 2_000_000) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``mu`` weighs a word's own probability against the pairs; ``head`` is how many words' counts
    a worker holds, 16 bytes each.
    """
    room = room or Workspace(docs.sparkSession)
    table, known, segments = count(train, room, head)
    sent = docs.sparkSession.sparkContext.broadcast(known)
    filters = table.where("kind = 1").select("segment", "at")
    asked = _texts(docs).mapInArrow(lambda batches: _ask(sent.value, segments, mu, batches), SENT)
    found = asked.groupBy("segment").cogroup(filters.groupBy("segment")).applyInArrow(lambda left, right: _gains(mu, left, right), SENT)
    if not known.whole:
        found = room.hold(found, "gains")
        rare = found.where(F.col("kind").isin(RARE_PAIRS, RARE_WORDS)).mapInArrow(lambda batches: _by_words(segments, batches), SENT)
        counted = table.where("kind = 0").select("segment", "at", "counts")
        more = rare.groupBy("segment").cogroup(counted.groupBy("segment")).applyInArrow(lambda left, right: _rare(sent.value, mu, left, right), SENT)
        found = found.where(F.col("kind").isin(ROWS, GAINS)).unionByName(more)
    rows = found.groupBy("chunk").applyInArrow(_total, SCORED)
    whole = float(np.log10(known.tokens + known.words + 1))
    return rows.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        "score",
    )
