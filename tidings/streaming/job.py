"""Campaign messages in, notification rows and messages out."""

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidings.functions.sizes import row_bytes
from tidings.operators import (
    dead_letters,
    decode_campaigns,
    incomplete,
    is_active,
    sendable,
    stamp,
    to_messages,
    with_feedback,
)
from tidings.plans import LaidOutFavourites, Limits
from tidings.plans.fanout import notifications
from tidings.plans.measure import Size
from tidings.schemas import MESSAGE_ID
from tidings.sinks import Batch, Sink
from tidings.streaming.progress import BatchCounts
from tidings.streaming.spool import Spool

log = logging.getLogger(__name__)


@dataclass
class NotificationJob:
    """One streaming query.

    Table rows are written before messages, and both from the same spooled
    result. A table sink that knows repeated batches has each row once; a message
    may be sent again. An error in a sink fails the query, so that Spark repeats
    the batch.
    """

    # Called in each batch, to see the newest.
    favourites: Callable[[], DataFrame | LaidOutFavourites]
    table: Sink
    messages: Sink
    letters: Sink
    name: str = "campaign_notifications"
    now: int | Column | None = None
    limits: Limits = field(default_factory=Limits)
    # Notifications of the last batches, which listeners look up and don't use up.
    sent: BatchCounts = field(default_factory=BatchCounts)
    _spark: SparkSession | None = field(default=None, init=False, repr=False)
    _spool: Spool | None = field(default=None, init=False, repr=False)
    _query_id: str | None = field(default=None, init=False, repr=False)

    def prepare(self, messages: DataFrame) -> DataFrame:
        """The messages worth keeping: active campaigns, and incomplete ones.

        The clock is read here, in the streaming plan, where a repeated batch
        gets the instant of its first attempt.
        """
        campaigns = stamp(decode_campaigns(messages, "payload"), self.now)
        observed = campaigns.observe(
            "campaigns",
            F.count("*").alias("messages"),
            F.count_if(incomplete()).alias("incomplete"),
            F.count_if(is_active(F.col("trigger_datetime_created"))).alias("active"),
        )
        return observed.filter(is_active(F.col("trigger_datetime_created")) | incomplete())

    def start(
        self, messages: DataFrame, checkpoint: str, trigger: dict | None = None
    ) -> StreamingQuery:
        """Start the query on a stream of messages with ids; ``trigger`` as for Spark."""
        self._spark = messages.sparkSession
        self._query_id = self._spool = None
        if MESSAGE_ID not in messages.columns:
            raise ValueError(f"the stream needs a column {MESSAGE_ID}, see functions.ids")
        writer = (
            self.prepare(messages)
            .writeStream.foreachBatch(self.process)
            .queryName(self.name)
            .option("checkpointLocation", checkpoint)
        )
        return (writer.trigger(**trigger) if trigger else writer).start()

    def process(self, batch: DataFrame, batch_id: int) -> None:
        key = Batch(self._id(), batch_id)
        batch.persist()
        try:
            size, rejected = self._count(batch)
            if rejected:
                self._write("dead letters", self.letters, dead_letters(batch), key)
            if not size.rows:
                self._note(batch_id, 0)
                return
            feedback = with_feedback(self._notifications(batch, size, key))
            self._write("notification rows", self.table, feedback, key)
            self._write("notification messages", self.messages, to_messages(feedback), key)
        finally:
            batch.unpersist()

    @staticmethod
    def _count(batch: DataFrame) -> tuple[Size, int]:
        """Size of the campaigns to send, and the number of dead letters."""
        counted = batch.agg(
            F.count_if(~incomplete()).alias("rows"),
            F.sum(F.when(~incomplete(), row_bytes(batch))).alias("bytes"),
            F.count_if(incomplete()).alias("rejected"),
        ).first()
        return Size(counted.rows, counted.bytes or 0), counted.rejected

    def _notifications(self, batch: DataFrame, size: Size, key: Batch) -> DataFrame:
        """The batch's notifications, from the spool."""
        spool = self._spool
        kept = spool.kept(key.batch_id)
        if kept is not None:
            log.info("batch %d: sending the notifications an earlier run found", key.batch_id)
            self._note(key.batch_id, spool.size(kept))
            return kept
        campaigns = sendable(batch).drop("payload")
        found = notifications(campaigns, size, self.favourites(), spool.workspace, self.limits)
        rows = Observation()
        held = spool.keep(key.batch_id, found.observe(rows, F.count("*").alias("rows")))
        self._note(key.batch_id, rows.get.get("rows", 0))
        return held

    def _note(self, batch_id: int, sent: int) -> None:
        """Keep a batch's number of notifications for whoever reports progress."""
        self.sent[batch_id] = sent

    def _id(self) -> str:
        """The query's id, which its checkpoint keeps across restarts."""
        if self._query_id is None:
            active = self._spark.streams.active
            named = [query.id for query in active if query.name == self.name]
            if len(named) != 1:
                raise RuntimeError(f"{len(named)} active queries are named {self.name!r}, one is needed")
            self._query_id = named[0]
            self._spool = Spool(self._spark, self._query_id)
        return self._query_id

    def _write(self, what: str, sink: Sink, df: DataFrame, key: Batch) -> None:
        try:
            sink(df, key)
        except Exception:
            log.exception("batch %d: writing %s failed", key.batch_id, what)
            raise
