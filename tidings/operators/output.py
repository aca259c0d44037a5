"""Shapes of the two outputs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.schemas import FEEDBACK_COLUMNS, HEADER_COLUMNS


def with_feedback(notifications: DataFrame) -> DataFrame:
    """Add the empty feedback column that the user fills in later."""
    return notifications.withColumn("feedback", F.lit(None).cast("string"))


def to_messages(notifications: DataFrame) -> DataFrame:
    """One JSON text per row, in column order; NULL fields are left out.

    Notifications that carry their message id get ``headers`` as well, in the shape that a topic takes:
    a message that is sent again has the same ones, so a consumer can tell it from
    a second notification with the same text.
    """
    columns = [c for c in FEEDBACK_COLUMNS if c in notifications.columns]
    value = F.to_json(F.struct(*columns)).alias("value")
    if not set(HEADER_COLUMNS) <= set(notifications.columns):
        return notifications.select(value)
    headers = [F.struct(F.lit(name).alias("key"), F.col(name).cast("binary").alias("value")) for name in HEADER_COLUMNS]
    return notifications.select(value, F.array(*headers).alias("headers"))
