"""The current batch's notifications, written once for both sinks."""

from pyspark.sql import DataFrame, SparkSession

from tidings.plans.workspace import Workspace

TABLE, MARK = "notifications", "notifications_mark"


class Spool:
    """One table, replaced by every batch, and a mark that names the batch in it.

    Both sinks read what was written, so they agree even when executors are lost
    in between, and so does a repeat of the batch, although favourites may have
    changed meanwhile. A batch begins after the one before it is committed, so
    one table is enough.
    """

    def __init__(self, spark: SparkSession, query_id: str):
        self._spark = spark
        self._workspace = Workspace(spark, query_id)
        self._fresh = True

    @property
    def workspace(self) -> Workspace:
        return self._workspace

    def kept(self, batch_id: int) -> DataFrame | None:
        """The notifications of a batch that an earlier run left uncommitted."""
        if not self._fresh:
            return None
        self._fresh = False
        self._workspace.ensure(self._marked(0, 0), MARK)
        mark = self._workspace.read(MARK, "batch_id long").first()
        return self._workspace.read(TABLE) if mark and mark.batch_id == batch_id else None

    def keep(self, batch_id: int, notifications: DataFrame) -> DataFrame:
        held = self._workspace.hold(notifications, TABLE)
        self._workspace.hold(self._marked(batch_id, batch_id + 1), MARK)
        return held

    @staticmethod
    def size(kept: DataFrame) -> int:
        """How many notifications a kept table has; only the files' footers are read."""
        return kept.count()

    def _marked(self, start: int, end: int) -> DataFrame:
        return self._spark.range(start, end, 1, 1).toDF("batch_id")
