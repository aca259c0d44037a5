"""Identity of a source message, the same each time the message is read."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def topic_message_id() -> Column:
    """Position in a topic."""
    return F.concat_ws(":", "topic", "partition", "offset")


def file_message_id() -> Column:
    """Position in a Parquet file."""
    return F.concat_ws(":", "_metadata.file_path", "_metadata.row_index")
