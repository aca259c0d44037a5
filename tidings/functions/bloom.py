"""A Bloom filter as a small table: built by an aggregate, probed by a broadcast join.

Ids are hashed to blocks of eight 64-bit words and set one bit in each word. A block is a row,
so the filter is built like any aggregate, partly before its shuffle, and probing stays in
compiled code. With ten bits an id it lets about 1 % of other ids through, and every id
that it was built from.
"""

from dataclasses import dataclass
from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
WORD_BITS = 64
BITS_PER_ID = 10
# Fewer bits an id let too much through to be worth the probe.
LEAST_BITS_PER_ID = 4
# A block's row in a hashed relation: key, words, and the share of the hash table.
BLOCK_BYTES = 8 * (WORDS + 2) + 48


def blocks_for(ids: int, most_bytes: int) -> int | None:
    """Blocks for so many different ids; None where a filter of ``most_bytes`` is too small for them."""
    bits = WORDS * WORD_BITS
    wanted = max(1, ceil(ids * BITS_PER_ID / bits))
    room = most_bytes // BLOCK_BYTES
    if wanted <= room:
        return wanted
    return room if room * bits >= ids * LEAST_BITS_PER_ID else None


def _block(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks))


def _bits(column: str) -> list[Column]:
    """For each word the one bit that an id sets."""
    other = F.xxhash64(F.lit(1), F.col(column))
    return [
        F.call_function(
            "shiftleft",
            F.lit(1).cast("long"),
            F.shiftrightunsigned(other, 6 * word).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int"),
        )
        for word in range(WORDS)
    ]


@dataclass(frozen=True)
class Bloom:
    """``table`` has a row for each block that isn't empty, ``blocks`` at most."""

    table: DataFrame
    column: str
    blocks: int

    @classmethod
    def of(cls, ids: DataFrame, column: str, blocks: int) -> "Bloom":
        bits = [bit.alias(f"bit{word}") for word, bit in enumerate(_bits(column))]
        rows = ids.where(F.col(column).isNotNull()).select(_block(column, blocks).alias("_block"), *bits)
        words = [F.bit_or(f"bit{word}").alias(f"_word{word}") for word in range(WORDS)]
        return cls(rows.groupBy("_block").agg(*words), column, blocks)

    def maybe(self, df: DataFrame) -> DataFrame:
        """The rows whose id the filter may have: all that were put in, and few others."""
        hit = [F.col(f"_word{word}").bitwiseAND(bit) != 0 for word, bit in enumerate(_bits(self.column))]
        at = _block(self.column, self.blocks) == F.col("_block")
        return df.join(F.broadcast(self.table), reduce(and_, hit, at), "left_semi")  # sized by blocks_for
