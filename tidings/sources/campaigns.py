"""Streams of campaign messages: binary key and value, and the message id."""

from pyspark.sql import DataFrame, SparkSession

from tidings.config import KafkaConfig
from tidings.functions.ids import file_message_id, topic_message_id
from tidings.schemas import MESSAGE_ID

MESSAGE_SCHEMA = "key binary, value binary"


def topic_options(cfg: KafkaConfig) -> dict[str, str]:
    """Options to read one topic.

    ``maxRecordsPerPartition`` cuts the offsets of a busy topic partition into
    several tasks.
    """
    options = {
        **cfg.connection(),
        "subscribe": cfg.topic,
        "startingOffsets": cfg.starting_offsets,
    }
    if cfg.max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(cfg.max_offsets_per_trigger)
    if cfg.max_records_per_partition:
        options["maxRecordsPerPartition"] = str(cfg.max_records_per_partition)
    return options


def campaign_stream(spark: SparkSession, cfg: KafkaConfig) -> DataFrame:
    """Stream one topic."""
    messages = spark.readStream.format("kafka").options(**topic_options(cfg)).load()
    return messages.select("key", "value", topic_message_id().alias(MESSAGE_ID))


def file_campaign_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Stream the Parquet files of a folder."""
    reader = spark.readStream.schema(MESSAGE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path).select("key", "value", file_message_id().alias(MESSAGE_ID))
