"""File sinks whose readers see whole batches only.

Every attempt at a batch writes a folder of its own under ``data``, which no other attempt
touches. A row in the sink's table ``commits`` then names that folder: it is written last, by one task,
so it is there or it isn't. Readers take the folders that commits name, by partition pruning, and
nothing else. So a batch appears at once and whole, whatever a sink that was killed left behind,
and a batch that was committed is never written again: its repeat changes nothing that readers
have seen. Of two commits of a batch, as after two drivers for one query, the earlier counts.
"""

import logging
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidings.schemas import FEEDBACK_SCHEMA, LETTER_SCHEMA
from tidings.sinks import Batch

log = logging.getLogger(__name__)

MESSAGE_SCHEMA = StructType([StructField("value", StringType())])
PLACE = "query_id string, batch_id long, attempt string"
PLACE_COLUMNS = ["query_id", "batch_id", "attempt"]
COMMIT = "batch_id long, attempt string, committed_at timestamp"
# Commits of so many batches share a folder, which is all that a sink reads before it writes.
BLOCK = 1000


class FileSink:
    """Writes batches as ``form`` under ``path``; a repeat of a committed batch is left out."""

    def __init__(self, path: str, form: str, columns: Sequence[str] | None = None):
        self.path, self.form, self.columns = path, form, columns

    def __call__(self, df: DataFrame, batch: Batch) -> None:
        spark = df.sparkSession
        if self.committed(spark, batch):
            log.info("%s has batch %d already", self.path, batch.batch_id)
            return
        self.commit(spark, batch, self.draft(df, batch))

    def draft(self, df: DataFrame, batch: Batch) -> str:
        """Write the rows where no reader looks yet; the attempt's name."""
        attempt = uuid.uuid4().hex
        rows = df.select(*self.columns) if self.columns else df
        place = f"query_id={batch.query_id}/batch_id={batch.batch_id}/attempt={attempt}"
        rows.write.format(self.form).save(f"{self.path}/data/{place}")
        return attempt

    def commit(self, spark: SparkSession, batch: Batch, attempt: str) -> None:
        """Show readers an attempt's rows."""
        row = spark.range(1).select(
            F.lit(batch.batch_id).cast("long").alias("batch_id"),
            F.lit(attempt).alias("attempt"),
            F.current_timestamp().alias("committed_at"),
        )
        row.coalesce(1).write.mode("append").parquet(self._block(batch))

    def committed(self, spark: SparkSession, batch: Batch) -> bool:
        known = _there(spark, lambda: spark.read.schema(COMMIT).parquet(self._block(batch)))
        return known is not None and not known.where(F.col("batch_id") == batch.batch_id).isEmpty()

    def _block(self, batch: Batch) -> str:
        return f"{self.path}/commits/query_id={batch.query_id}/block={batch.batch_id // BLOCK}"


def read(spark: SparkSession, path: str, form: str, schema: StructType) -> DataFrame:
    """The committed rows of a sink; none before its first commit."""
    commits = _there(
        spark,
        lambda: spark.read.schema(f"{COMMIT}, query_id string, block long").parquet(f"{path}/commits"),
    )
    if commits is None:
        return spark.createDataFrame([], schema)
    # The filter, true of all, lets Spark prune folders by the join: it does so for filtered tables only.
    first = commits.where("batch_id >= 0").groupBy("query_id", "batch_id").agg(
        F.min(F.struct("committed_at", "attempt")).alias("first")
    )
    shown = first.select("query_id", "batch_id", "first.attempt")
    placed = StructType([*schema.fields, *StructType.fromDDL(PLACE).fields])
    rows = spark.read.schema(placed).format(form).load(f"{path}/data")
    return rows.join(shown, PLACE_COLUMNS, "left_semi").select(*schema.fieldNames())


def leftovers(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Attempts that no reader is shown: drafts that a sink left behind, and one that may be under way."""
    attempts = _there(spark, lambda: spark.read.schema(PLACE).format(form).load(f"{path}/data"))
    if attempts is None:
        return spark.createDataFrame([], PLACE)
    shown = _there(spark, lambda: spark.read.schema(f"{COMMIT}, query_id string, block long").parquet(f"{path}/commits"))
    attempts = attempts.select(*PLACE_COLUMNS).distinct()
    return attempts if shown is None else attempts.join(shown, PLACE_COLUMNS, "left_anti")


def _there(spark: SparkSession, read) -> DataFrame | None:
    """What ``read`` reads, unless the folder isn't there yet."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def parquet_table(path: str) -> FileSink:
    """Table rows as Parquet."""
    return FileSink(path, "parquet", FEEDBACK_SCHEMA.fieldNames())


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``parquet_table`` wrote."""
    return read(spark, path, "parquet", FEEDBACK_SCHEMA)


def text_messages(path: str) -> FileSink:
    """Messages as lines of text."""
    return FileSink(path, "text", ["value"])


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """The messages that ``text_messages`` wrote."""
    return read(spark, path, "text", MESSAGE_SCHEMA)


def parquet_letters(path: str) -> FileSink:
    """Dead letters as Parquet."""
    return FileSink(path, "parquet", LETTER_SCHEMA.fieldNames())


def read_letters(spark: SparkSession, path: str) -> DataFrame:
    """The letters that ``parquet_letters`` wrote."""
    return read(spark, path, "parquet", LETTER_SCHEMA)
