"""Common lines dropped from documents, with an index that takes documents in and out.

A line's key is the line without the bytes 0x20 and 0x09-0x0D at both ends, A-Z lower-cased.
The index counts exactly in how many documents each key occurs, however often in one. A line
is common when its key has ``least_chars`` code points and ``least_docs`` documents.

State. Keys are 128-bit hashes, dealt to shards by their top bits. A shard has the exact counts
of its keys, a cuckoo filter of the common ones, and the rare keys that the filter takes for common, by
which its answers are exact for every line the index has counted. Putting documents in and
taking them out adds to the counts and moves just those keys in or out of the filter whose
count crossed the threshold. Documents are counted as keys as well: one that was never put in
can't be taken out. Each change is a new version of the state, written whole, and named in a table
of versions last; what fails half-way leaves the version before it. The number of shards follows the
keys; when it changes the filters are built again from the counts.

Dropping. Filters of up to ``filter_mb``, measured, are broadcast and documents don't move. Larger
ones are not: the different lines of different texts are joined with the counts then, and what is common
comes back by the text. Both give the same.

Nulls: a null or empty text is one empty line; an empty line is never common. A null id is an id.
Equal rows are documents each. A text without a common line is returned byte for byte. Lines of any
length are taken whole. Other columns are ignored. No documents give no rows. Two lines count
as equal if their 128-bit hashes are; a line that no counted document has may be taken for a common one
with a probability of 2e-9, unless ``exact``.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidings.llm import cuckoo
from tidings.llm.words import slices
from tidings.plans import Workspace

log = logging.getLogger(__name__)

SPACE = b" \t\n\x0b\x0c\r"
LINE, DOCUMENT, FILTER = 0, 1, 2
#: Keys that one shard's task holds, about 40 bytes each.
SHARD_KEYS = 500_000
#: Keys that a task sums up before it passes them on.
SUMMED_KEYS = 200_000

STATE = "shard int, kind tinyint, h1 long, h2 long, docs long, slots binary, wrong binary"
COUNTS = "kind tinyint, h1 long, h2 long, docs long"
KEPT = "doc_id long, n_lines long, n_dropped long, kept string"


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _pairs(hashes: list[bytes]) -> np.ndarray:
    """The hashes as rows of two 64-bit numbers."""
    return np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)


def split(text: bytes, least_chars: int) -> tuple[list[bytes], list[bytes], list[int]]:
    """A text's lines, the hashes of those that may be common, and which ones these are."""
    lines = text.split(b"\n")
    hashes, at = [], []
    for number, line in enumerate(lines):
        key = line.strip(SPACE).lower()
        if key and (least_chars <= 1 or len(key.decode("utf-8", "replace")) >= least_chars):
            hashes.append(_hash(key))
            at.append(number)
    return lines, hashes, at


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[object, bytes]]:
    ids = batch.column("doc_id").to_pylist()
    for one, text in zip(ids, batch.column("text").cast(pa.large_binary())):
        yield one, (text.as_buffer().to_pybytes() if text.is_valid else b"")


def _count(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[pa.RecordBatch]:
    """How many of the task's documents have each key, and how often it has each document."""
    sums: dict[tuple[int, bytes], int] = {}

    def told() -> pa.RecordBatch:
        pairs = _pairs([key for _, key in sums]).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([kind for kind, _ in sums], pa.int8()),
                pa.array(pairs[:, 0]),
                pa.array(pairs[:, 1]),
                pa.array(list(sums.values()), pa.int64()),
            ],
            ["kind", "h1", "h2", "docs"],
        )

    for batch in batches:
        for one, text in _texts(batch):
            keys = [(LINE, key) for key in set(split(text, least_chars)[1])]
            for key in [*keys, (DOCUMENT, _hash(f"{one}\n".encode() + text))]:
                sums[key] = sums.get(key, 0) + 1
            if len(sums) >= SUMMED_KEYS:
                yield told()
                sums.clear()
    if sums:
        yield told()


def _update(table: pa.Table, least_docs: int) -> pa.Table:
    """A shard's next state from its old one and the changes."""
    kinds = table["kind"].to_numpy()
    shard = table["shard"][0].as_py()
    old = table.filter(pa.array(kinds == FILTER))
    table = table.filter(pa.array(kinds != FILTER))
    kind, h1, h2 = (table[name].to_numpy() for name in ("kind", "h1", "h2"))
    docs, was = table["docs"].to_numpy(), table["was"].to_numpy()
    order = np.lexsort((h2, h1, kind))
    kind, h1, h2 = kind[order], h1[order], h2[order]
    starts = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))) if len(kind) else np.zeros(0, np.int64)
    before = np.add.reduceat(was[order], starts) if len(starts) else was
    after = np.add.reduceat(docs[order], starts) if len(starts) else docs
    kind, first, second = kind[starts], h1[starts].astype(np.int64).view(np.uint64), h2[starts].astype(np.int64).view(np.uint64)
    if (after < 0).any():
        raise ValueError("documents can't be taken out that were never put in")
    line = kind == LINE
    common = line & (after >= least_docs)
    slots = np.frombuffer(old["slots"][0].as_py(), np.uint32).reshape(-1, cuckoo.SLOTS).copy() if len(old) else None
    if slots is None or common.sum() > slots.size * 0.95:
        slots = cuckoo.built(first[common], second[common])
    else:
        held = line & (before >= least_docs)
        cuckoo.take(slots, first[held & ~common], second[held & ~common])
        try:
            cuckoo.put(slots, first[common & ~held], second[common & ~held])
        except cuckoo.Full:
            slots = cuckoo.built(first[common], second[common])
    rare = np.flatnonzero(line & (after > 0) & ~common)
    wrong = rare[cuckoo.Shards(0, slots, np.zeros(1, np.int64), np.array([len(slots) - 1], np.uint64)).holds(first[rare], second[rare])]
    kept = np.flatnonzero(after > 0)
    size = len(kept) + 1
    alone = [None] * (size - 1)
    return pa.table(
        {
            "shard": pa.array(np.full(size, shard), pa.int32()),
            "kind": pa.array(np.append(kind[kept], FILTER), pa.int8()),
            "h1": pa.array(np.append(first[kept].view(np.int64), 0)),
            "h2": pa.array(np.append(second[kept].view(np.int64), 0)),
            "docs": pa.array(np.append(after[kept], common.sum()), pa.int64()),
            "slots": pa.array([*alone, slots.tobytes()], pa.binary()),
            "wrong": pa.array([*alone, np.stack((first[wrong], second[wrong]), axis=1).tobytes()], pa.binary()),
        }
    )


def _answer(batch: pa.RecordBatch, kept: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array([lines for lines, _, _ in kept], pa.int64()),
            pa.array([dropped for _, dropped, _ in kept], pa.int64()),
            pa.array([text for _, _, text in kept], pa.binary()).cast(pa.string()),
        ],
        ["doc_id", "n_lines", "n_dropped", "kept"],
    )


def _without(lines: list[bytes], dropped: set[int]) -> tuple[int, int, bytes]:
    if not dropped:
        return len(lines), 0, b"\n".join(lines)
    return len(lines), len(dropped), b"\n".join(line for at, line in enumerate(lines) if at not in dropped)


class LineIndex:
    """The lines of a collection of documents; see the module's text.

    ``room`` is where the state lies: give the same one and settings to go on with an index.
    Each of ``insert`` and ``delete`` is a version; ``least_docs`` and ``least_chars`` hold for all.
    """

    def __init__(self, spark: SparkSession, room: Workspace, least_docs: int = 10, least_chars: int = 1, filter_mb: int = 64):
        if least_docs < 1:
            raise ValueError("a line is common from one document on")
        self._spark, self._room = spark, room
        self._least_docs, self._least_chars, self._filter_bytes = least_docs, least_chars, filter_mb << 20
        room.ensure(spark.createDataFrame([], "version long, bits int"), "versions")

    def _version(self) -> tuple[int, int]:
        """The last whole version and the bits of its shards."""
        found = self._room.read("versions", "version long, bits int").agg(F.max(F.struct("version", "bits")).alias("last")).first().last
        return (found.version, found.bits) if found else (0, 0)

    def _state(self, version: int) -> DataFrame:
        return self._room.read(f"state-{version}", STATE)

    def insert(self, docs: DataFrame) -> None:
        """Count the documents in."""
        self._change(docs, 1)

    def delete(self, docs: DataFrame) -> None:
        """Count documents out that are in, known by id and text; raises if one isn't, and changes nothing."""
        self._change(docs, -1)

    def _change(self, docs: DataFrame, sign: int) -> None:
        least_chars, least_docs = self._least_chars, self._least_docs
        version, bits = self._version()
        rows = Observation()
        changes = _bare(docs).mapInArrow(lambda batches: _count(batches, least_chars), COUNTS)
        changes = self._room.hold(changes.observe(rows, F.count("*").alias("rows")), f"changes-{version + 1}")
        keys = rows.get.get("rows") or 0
        if version:
            keys += self._state(version).where(F.col("kind") != FILTER).count()
        wanted = max(bits, 4, (max(keys, 1) // SHARD_KEYS).bit_length())
        shard = F.shiftrightunsigned("h1", 64 - wanted).cast("int").alias("shard")
        none = F.lit(None).cast("binary")
        moved = changes.select(shard, "kind", "h1", "h2", (F.col("docs") * sign).alias("docs"), F.lit(0).cast("long").alias("was"), none.alias("slots"))
        if version:
            state = self._state(version)
            old = state.where(F.col("kind") != FILTER).select(shard, "kind", "h1", "h2", "docs", F.col("docs").alias("was"), none.alias("slots"))
            moved = moved.unionByName(old)
            if wanted == bits:
                moved = moved.unionByName(state.where(F.col("kind") == FILTER).select("shard", "kind", "h1", "h2", "docs", F.lit(0).cast("long").alias("was"), "slots"))
        found = moved.groupBy("shard").applyInArrow(lambda table: _update(table, least_docs), STATE)
        self._room.hold(found, f"state-{version + 1}")
        self._spark.createDataFrame([(version + 1, wanted)], "version long, bits int").write.mode("append").parquet(f"{self._room.path}/versions")

    def counts(self) -> DataFrame:
        """``h1``, ``h2`` of every line that is in, and how many ``docs`` have it."""
        version, _ = self._version()
        if not version:
            return self._spark.createDataFrame([], "h1 long, h2 long, docs long")
        return self._state(version).where(F.col("kind") == LINE).select("h1", "h2", "docs")

    def clean(self, docs: DataFrame, exact: bool = False) -> DataFrame:
        """``doc_id``, ``n_lines``, ``n_dropped`` and the ``kept`` lines of each document, in the index or not.

        ``exact`` looks the lines up in the counts, also those that no counted document has.
        """
        version, bits = self._version()
        if not version:
            return self._join(docs)
        filters = self._state(version).where(F.col("kind") == FILTER)
        size = filters.agg(F.sum(F.octet_length("slots") + F.octet_length("wrong")).alias("bytes")).first().bytes or 0
        if exact or size > self._filter_bytes:
            log.info("looking lines up in the counts; filters have %d bytes", size)
            return self._join(docs)
        return self._probe(docs, filters, bits)

    def _probe(self, docs: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
        least_chars = self._least_chars
        found = filters.select("shard", "slots", "wrong").collect()  # up to filter_mb
        shards = cuckoo.Shards.of(bits, {row.shard: np.frombuffer(row.slots, np.uint32).reshape(-1, cuckoo.SLOTS) for row in found})
        wrong = {bytes(row.wrong[at : at + 16]) for row in found for at in range(0, len(row.wrong), 16)}
        sent = self._spark.sparkContext.broadcast((shards, wrong))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards, wrong = sent.value
            for batch in batches:
                for some in slices(batch, "text"):
                    parted = [split(text, least_chars) for _, text in _texts(some)]
                    hashes = [key for _, keys, _ in parted for key in keys]
                    pairs = _pairs(hashes)
                    drop = shards.holds(pairs[:, 0], pairs[:, 1])
                    kept, start = [], 0
                    for lines, keys, at in parted:
                        hits = np.flatnonzero(drop[start : start + len(keys)])
                        kept.append(_without(lines, {at[hit] for hit in hits if not wrong or keys[hit] not in wrong}))
                        start += len(keys)
                    yield _answer(some, kept)

        return _bare(docs).mapInArrow(run, KEPT)

    def _join(self, docs: DataFrame) -> DataFrame:
        """By the counts: the different lines of different texts, and their common ones by text."""
        least_chars = self._least_chars
        named = _bare(docs).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})

        def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in slices(batch, "text"):
                    keys = [list(set(split(text, least_chars)[1])) for _, text in _texts(some)]
                    row = pa.array(np.repeat(np.arange(len(keys)), [len(one) for one in keys]))
                    pairs = _pairs([key for one in keys for key in one]).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("t1").take(row), some.column("t2").take(row), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                        ["t1", "t2", "h1", "h2"],
                    )

        held = named.mapInArrow(lines, "t1 long, t2 long, h1 long, h2 long").distinct()
        common = self.counts().where(F.col("docs") >= self._least_docs).select("h1", "h2")
        of_text = held.join(common, ["h1", "h2"]).groupBy("t1", "t2").agg(F.collect_list(F.struct("h1", "h2")).alias("common"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in slices(batch, "text"):
                    kept = []
                    for (_, text), common in zip(_texts(some), some.column("common").to_pylist()):
                        lines, keys, at = split(text, least_chars)
                        hits = {np.array([one["h1"], one["h2"]], "<i8").tobytes() for one in common or ()}
                        kept.append(_without(lines, {place for place, key in zip(at, keys) if key in hits}))
                    yield _answer(some, kept)

        return named.join(of_text, ["t1", "t2"], "left").select("doc_id", "text", "common").mapInArrow(run, KEPT)


def _bare(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
