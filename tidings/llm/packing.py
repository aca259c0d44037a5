"""Documents cut into sequences whose lengths are powers of two.

A document of n tokens becomes pieces of the most tokens allowed and one piece for
each binary digit of the rest, the longest first. Each piece is a sequence of its own,
so none crosses documents and none is padded; ``length`` is the bucket that batches
of equal length are drawn from.

Nulls: a null text is empty and gives one piece, the end id; a null id stays null.
Equal rows and ids are packed apart. Other columns are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.chunks import encoder
from tidings.llm.words import give_back, slices

#: Sequences that one task can number.
TASK_BITS = 36


def pieces(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and length of each piece; ``most`` is a power of two."""
    digits = [1 << bit for bit in range(most.bit_length() - 2, -1, -1)]
    times = np.stack([counts // most] + [(counts & digit) != 0 for digit in digits], axis=1)
    lengths = np.tile([most, *digits], len(counts))
    times = times.astype(np.int64).ravel()
    return np.repeat(np.repeat(np.arange(len(counts)), len(digits) + 1), times), np.repeat(lengths, times)


def pack(docs: DataFrame, tokenizer: str, end_id: int, most: int = 2048) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids.

    ``ids`` holds little-endian unsigned 32-bit integers. Nothing is moved: a task numbers
    its own sequences above its place among the tasks.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        number = TaskContext.get().partitionId() << TASK_BITS
        for batch in batches:
            for one in slices(batch, "text", 1_000_000):
                found, size = encoder(tokenizer)(one.column("text"))
                ids = np.insert(found, np.cumsum(size), end_id).astype("<u4")
                size = size + 1
                owner, length = pieces(size, most)
                begin = np.cumsum(length) - length
                start = begin - (np.cumsum(size) - size)[owner]
                bounds = np.append(begin, len(ids)).astype(np.int64) * 4
                values = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(ids)]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        one.column("doc_id").take(pa.array(owner)),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(size[owner], pa.int64()),
                        pa.array(number + np.arange(len(length)), pa.int64()),
                        pa.array(np.zeros(len(length)), pa.int64()),
                        values.cast(pa.binary()),
                    ],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )
                number += len(length)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return rows.mapInArrow(cut, schema)


PIECES = "doc_id long, start long, doc_tokens long, sequence_id long, offset long, ids binary"


def write_buckets(packed: DataFrame, folder: str) -> None:
    """Write the sequences with a folder for each length, from which batches of equal length are read."""
    packed.write.partitionBy("length").mode("overwrite").parquet(folder)


def read_buckets(spark: SparkSession, folder: str, lengths: list[int] | None = None) -> DataFrame:
    """The sequences of the buckets, or of some of them; the others aren't read."""
    found = spark.read.schema(f"{PIECES}, length long").parquet(folder)
    return found if lengths is None else found.where(F.col("length").isin(lengths))


def digests(packed: DataFrame) -> DataFrame:
    """The pieces with their ids' unsigned CRC-32 in place of the ids."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
