"""Campaign messages: decode, keep the active ones, set the bad ones aside."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.clock import instant
from tidings.schemas import CAMPAIGN_COLUMNS, CAMPAIGN_SCHEMA, MESSAGE_ID


def message_text(messages: DataFrame) -> DataFrame:
    """Binary key and value as text."""
    return messages.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
    )


def decode_campaigns(messages: DataFrame, corrupt_record: str | None = None) -> DataFrame:
    """JSON payloads in the binary ``value`` column to the eight campaign columns.

    Every message gives one row; whatever cannot be decoded is NULL. With
    ``corrupt_record`` a column of that name holds the raw text of the messages
    that did not give all eight values.

    The decoded struct goes through ``inline`` because Catalyst pushes the filter
    on the campaign's start and end below a plain projection and would then parse
    each payload once per predicate, and once more for the rows it keeps.
    """
    carried = [MESSAGE_ID] if MESSAGE_ID in messages.columns else []
    payload = messages.select(*carried, F.col("value").cast("string").alias("_payload"))
    decoded = payload.select(
        *carried, "_payload", F.inline(F.array(F.from_json("_payload", CAMPAIGN_SCHEMA)))
    )
    if corrupt_record is None:
        return decoded.drop("_payload")
    return decoded.select(
        *carried,
        *CAMPAIGN_COLUMNS,
        F.when(incomplete(), F.col("_payload")).alias(corrupt_record),
    )


def is_active(now: int | Column | None = None) -> Column:
    """Start inclusive, end exclusive."""
    at = instant(now)
    return (F.col("adv_campaign_datetime_start") <= at) & (F.col("adv_campaign_datetime_end") > at)


def active_at(campaigns: DataFrame, now: int | Column | None = None) -> DataFrame:
    """Campaigns that run at ``now``; a NULL start or end drops the row."""
    return campaigns.filter(is_active(now))


def stamp(campaigns: DataFrame, now: int | Column | None = None) -> DataFrame:
    """Add the instant the notification is made, as the 32-bit int of its table.

    With ANSI mode on, the cast raises from 2038-01-19 on.
    """
    return campaigns.withColumn("trigger_datetime_created", instant(now).cast("int"))


def incomplete() -> Column:
    """True when a field that the notification table requires is missing."""
    return reduce(or_, [F.col(name).isNull() for name in CAMPAIGN_COLUMNS])


def sendable(campaigns: DataFrame) -> DataFrame:
    """Campaigns with every field that the notification table requires; the others are dead letters."""
    return campaigns.filter(~incomplete())


def dead_letters(campaigns: DataFrame, payload: str = "payload") -> DataFrame:
    """The incomplete messages: their id, raw text, and the fields they lack."""
    lacking = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in CAMPAIGN_COLUMNS])
    return campaigns.filter(incomplete()).select(
        MESSAGE_ID, F.col(payload).alias("payload"), lacking.alias("missing_fields")
    )
