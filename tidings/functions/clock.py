"""The processing-time clock."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(now: int | Column | None = None) -> Column:
    """``now`` as a column of epoch seconds; the current time when it is None.

    In a streaming plan the current time is the micro-batch's own, which Spark
    logs with the offsets, so a replayed batch sees the same instant.
    """
    if now is None:
        return F.current_timestamp().cast("long")
    return now if isinstance(now, Column) else F.lit(now)
