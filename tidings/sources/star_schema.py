"""Campaigns and favourites derived from the star-schema test tables."""

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidings.functions.ids import topic_message_id
from tidings.schemas import CAMPAIGN_COLUMNS, MESSAGE_ID


@cache
def _schema(spark: SparkSession, folder: str, name: str) -> StructType:
    """Read from the files' footers once, as a catalog would keep it."""
    return spark.read.parquet(f"{folder}/{name}.parquet").schema


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_schema(spark, folder, name)).parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table's files as a stream; a stream of one file must be given as a pattern, here one that fits nothing else."""
    schema = _schema(spark, folder, name)
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def campaigns(events: DataFrame) -> DataFrame:
    """One campaign per event; ``events`` may be a stream."""
    user = F.col("user_id").cast("string")
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    hours = 1 + F.get_json_object("props", "$.k").cast("int") % 6
    owner = F.concat(F.lit("owner-"), user)
    return events.select(
        F.col("event_id").cast("string").alias(MESSAGE_ID),
        user.alias("restaurant_id"),
        F.col("event_id").cast("string").alias("adv_campaign_id"),
        F.col("event_type").alias("adv_campaign_content"),
        owner.alias("adv_campaign_owner"),
        F.concat(owner, F.lit("@example.com")).alias("adv_campaign_owner_contact"),
        start.alias("adv_campaign_datetime_start"),
        (start + 3600 * hours).alias("adv_campaign_datetime_end"),
        (start - 72000).alias("datetime_created"),
    )


def messages(events: DataFrame) -> DataFrame:
    """The campaigns as a topic would deliver them."""
    return _delivered(campaigns(events), F.to_json(F.struct(*CAMPAIGN_COLUMNS)))


def faulty_messages(events: DataFrame) -> DataFrame:
    """The same with a fault in the payload that depends on the event's type."""
    whole = F.to_json(F.struct(*CAMPAIGN_COLUMNS))
    kind = F.col("adv_campaign_content")
    payload = (
        F.when(kind == "error", F.concat(F.lit("not json "), whole))
        .when(kind == "signup", _payload(adv_campaign_datetime_start="string"))
        .when(kind == "purchase", _payload(adv_campaign_owner=None))
        .when(kind == "view", F.concat(whole, F.lit(" trailing")))
        .otherwise(F.to_json(F.struct(*CAMPAIGN_COLUMNS, F.lit(1).alias("extra"))))
    )
    return _delivered(campaigns(events), payload)


def _payload(**changed: str | None) -> Column:
    """Payload with some fields of another type, or left out."""
    fields = [
        F.col(name).cast(changed[name]).alias(name) if name in changed else F.col(name)
        for name in CAMPAIGN_COLUMNS
        if name not in changed or changed[name]
    ]
    return F.to_json(F.struct(*fields))


def _delivered(campaigns: DataFrame, payload: Column) -> DataFrame:
    records = campaigns.select(
        F.col(MESSAGE_ID).cast("binary").alias("key"),
        payload.cast("binary").alias("value"),
        F.lit("campaigns").alias("topic"),
        F.lit(0).alias("partition"),
        F.col(MESSAGE_ID).alias("offset"),
    )
    return records.select("key", "value", topic_message_id().alias(MESSAGE_ID))


def favourites(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and the suppliers of their order lines, with duplicates."""
    return numbered_favourites(spark, folder).drop("id")


def numbered_favourites(spark: SparkSession, folder: str) -> DataFrame:
    """The same with ids that have gaps: a third of the orders is far from the others."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    order = F.col("l_orderkey").cast("long")
    far = F.when(order % 3 == 0, 1_000_000_000_000).otherwise(0)
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        (order * 8 + F.col("l_linenumber") + far).cast("long").alias("id"),
        F.col("o_custkey").cast("string").alias("client_id"),
        F.col("l_suppkey").cast("string").alias("restaurant_id"),
    )
