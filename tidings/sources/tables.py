"""The favourites table over JDBC."""

from pyspark.sql import DataFrame, SparkSession

from tidings.config import JdbcConfig
from tidings.sources.ranges import Bin, bins_sql, bounds_sql, ranges

PARTITION_COLUMN = "id"


def read_options(cfg: JdbcConfig) -> dict[str, str]:
    """The fetch size keeps a range from being buffered whole by the database driver."""
    return {**cfg.connection(), "fetchsize": str(cfg.batch_rows)}


def id_ranges(spark: SparkSession, cfg: JdbcConfig) -> list[str]:
    """Conditions on the id for as many connections as ``cfg`` wants, with about equally many rows."""

    def ask(sql: str) -> list:
        return spark.read.format("jdbc").options(**cfg.connection(), query=sql).load().collect()

    def count(low: int, high: int, width: int) -> list[Bin]:
        found = ask(bins_sql(cfg.table, PARTITION_COLUMN, low, high, width))
        return [Bin(int(low), int(high), int(rows)) for low, high, rows in found]

    (bounds,) = ask(bounds_sql(cfg.table, PARTITION_COLUMN))
    return ranges(tuple(bounds), count, cfg.partitions, PARTITION_COLUMN)


class Favourites:
    """The table as it is when called; call it again for each micro-batch.

    Filters on the restaurant, and the pruning to two columns, reach the database. Counting the ids
    costs the database a scan of their index, so ranges are kept for ``refresh`` calls:
    rows that come meanwhile are in one of them all the same, most in the last.
    """

    def __init__(self, spark: SparkSession, cfg: JdbcConfig, refresh: int = 1000):
        self._spark, self._cfg, self._refresh = spark, cfg, refresh
        self._ranges: list[str] = []
        self._calls = 0

    def __call__(self) -> DataFrame:
        if self._calls % self._refresh == 0:
            self._ranges = id_ranges(self._spark, self._cfg)
        self._calls += 1
        cfg = self._cfg
        options = read_options(cfg)
        url = options.pop("url")
        return self._spark.read.jdbc(url, cfg.table, predicates=self._ranges, properties=options)


def favourites(spark: SparkSession, cfg: JdbcConfig) -> DataFrame:
    """The table as it is now."""
    return Favourites(spark, cfg)()
