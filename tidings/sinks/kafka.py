"""Messages to a topic."""

from pyspark.sql import DataFrame

from tidings.config import KafkaConfig
from tidings.sinks import Batch, Sink


def topic_messages(cfg: KafkaConfig) -> Sink:
    """Send each message, without a key, at least once.

    Its headers, if it has any, name the notification: a consumer that has seen them has seen the message.
    """

    def write_messages(messages: DataFrame, batch: Batch) -> None:
        (
            messages.select("value", *(["headers"] if "headers" in messages.columns else []))
            .write.format("kafka")
            .options(**cfg.connection())
            .option("topic", cfg.topic)
            .save()
        )

    return write_messages
