"""A look at the incoming messages."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidings.operators import message_text


def tap(
    messages: DataFrame, checkpoint: str, name: str = "campaign_tap", rows: int = 20
) -> StreamingQuery:
    """Print keys and values as text, in a query of its own that blocks no other.

    Of each micro-batch ``rows`` messages are printed, and no more reach the driver.
    """

    def show(batch: DataFrame, batch_id: int) -> None:
        batch.show(rows, truncate=False)

    return (
        message_text(messages)
        .writeStream.foreachBatch(show)
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .start()
    )
