"""Stopping a query between two batches instead of within one."""

import logging
import signal
import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger(__name__)


def on_signal(*signals: int) -> threading.Event:
    """An event that the signals set; only the main thread may ask for it."""
    asked = threading.Event()

    def note(number: int, frame) -> None:
        log.info("%s: stopping after the running batch", signal.Signals(number).name)
        asked.set()

    for number in signals:
        signal.signal(number, note)
    return asked


def uncommitted(spark: SparkSession, checkpoint: str) -> bool:
    """Whether a query's checkpoint has a batch that began and didn't end."""
    begun, ended = (_last(spark, f"{checkpoint}/{name}") for name in ("offsets", "commits"))
    return begun > ended


def _last(spark: SparkSession, folder: str) -> int:
    """The number of the last batch in a log of the checkpoint, -1 without any; only names are read."""
    try:
        files: DataFrame = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*").load(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1
    number = F.regexp_extract("path", r"/(\d+)$", 1)
    found = files.where(number != "").agg(F.max(number.cast("long")).alias("last")).first().last
    return -1 if found is None else found


def run_until(
    spark: SparkSession,
    asked: threading.Event,
    query: StreamingQuery,
    checkpoint: str,
    again: Callable[[dict], StreamingQuery],
    poll: float = 0.2,
) -> None:
    """Wait for the query's end, or end it when asked to, with no batch half-way.

    A stop takes effect when no batch runs. If the next one has just begun after all,
    ``again`` starts the query once more for that batch alone. An error in the query is raised.
    """
    while not asked.is_set():
        if query.awaitTermination(poll):
            return
    while query.isActive and query.status["isTriggerActive"]:
        query.awaitTermination(poll)
    query.stop()
    if uncommitted(spark, checkpoint):
        log.info("finishing the batch that had begun")
        again({"once": True}).awaitTermination()
