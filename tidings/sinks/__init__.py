"""Where notifications go.

A sink is called as ``sink(df, batch)``. It must expect the same batch again:
Spark repeats a micro-batch that failed, or whose end was not recorded.
"""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame


class Batch(NamedTuple):
    """A micro-batch: the query's lasting id, and the number within the query."""

    query_id: str
    batch_id: int


Sink = Callable[[DataFrame, Batch], None]
