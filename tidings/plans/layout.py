"""Favourites kept in the layout that the fan-out reads them in.

Favourites change slowly against campaigns. Laid out once, they are deduped and bucketed by a
cell: the restaurant, and for a busy restaurant also the part of its clients. A
micro-batch then reads only the buckets of its campaigns' cells, and a join by the cell
needs no exchange of favourites. No bucket holds more of a busy restaurant than a part.
"""

import logging
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.operators import dedupe_favourites
from tidings.operators.fanout import to_notifications
from tidings.plans.heavy import heavy_restaurants
from tidings.plans.measure import Size
from tidings.plans.splits import SPLIT_SCHEMA, Cell
from tidings.plans.workspace import Workspace

log = logging.getLogger(__name__)

BUCKETS = 64


def _cell(part: Column) -> Column:
    """Names a restaurant and a part of its clients; it is the only key of the join, as of the buckets."""
    return F.concat(F.col("restaurant_id"), F.lit("#"), part)


def _parted(df: DataFrame, splits: DataFrame) -> DataFrame:
    """With the number of parts that the clients of the row's restaurant are cut into."""
    parts = F.broadcast(splits.select("restaurant_id", "client_parts"))  # short: see plans.heavy
    return df.join(parts, "restaurant_id", "left").withColumn("_parts", F.coalesce("client_parts", F.lit(1))).drop("client_parts")


@dataclass(frozen=True)
class LaidOutFavourites:
    """A table of the session's catalog, and beside it the busy restaurants it was cut by.

    ``lay_out`` writes a new one, that later batches may be given; an old one stays readable.
    """

    spark: SparkSession
    name: str
    path: str
    buckets: int

    @classmethod
    def lay_out(
        cls,
        favourites: DataFrame,
        workspace: Workspace,
        buckets: int = BUCKETS,
        cell: Cell = Cell(),
        name: str | None = None,
    ) -> "LaidOutFavourites":
        """Dedupe and bucket the favourites; ``buckets`` is a matter of their size, some 100 MB each."""
        spark = favourites.sparkSession
        name = name or f"tidings_favourites_{uuid.uuid4().hex}"
        path = f"{workspace.path}/{name}"
        # Parts of a quarter of a bucket's share: where some meet in a bucket it isn't much fuller than others.
        heavy = heavy_restaurants(favourites, 4 * buckets, cell)
        # One task writes the list, so that it is there whole or not at all.
        heavy.splits.coalesce(1).write.mode("overwrite").parquet(f"{path}/busy")
        parted = _parted(dedupe_favourites(favourites), spark.read.schema(SPLIT_SCHEMA).parquet(f"{path}/busy"))
        part = F.pmod(F.xxhash64("client_id"), F.col("_parts")).cast("int")
        rows = parted.select("client_id", "restaurant_id", _cell(part).alias("cell"))
        (
            # As Spark deals out buckets: each is written by one task, as one file.
            rows.repartition(buckets, "cell")
            .write.mode("overwrite")
            .bucketBy(buckets, "cell")
            .sortBy("cell")
            .option("path", f"{path}/pairs")
            .saveAsTable(name)
        )
        log.info("laid out %d favourites in %d buckets, %d busy restaurants", heavy.rows, buckets, heavy.restaurants)
        return cls(spark, name, path, buckets)

    def pairs(self) -> DataFrame:
        return self.spark.table(self.name)

    def splits(self) -> DataFrame:
        return self.spark.read.schema(SPLIT_SCHEMA).parquet(f"{self.path}/busy")

    def drop(self) -> None:
        """Forget the table; its files stay in the workspace."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def by_cell(campaigns: DataFrame, table: LaidOutFavourites) -> DataFrame:
    """Campaigns, which may be a stream, repeated over the cells of their restaurants."""
    part = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")
    parted = _parted(campaigns, table.splits()).select(*campaigns.columns, part)
    return parted.select(*campaigns.columns, _cell(F.col("_part")).alias("cell"))


def fan_out_by_cell(campaigns: DataFrame, table: LaidOutFavourites, cells: list[str] | None = None, hint: str = "merge") -> DataFrame:
    """The join by cell; favourites are read bucket by bucket and not shuffled.

    ``cells``, if the campaigns' are known and few, leaves the other buckets unread.
    ``hint`` is how to join: by ``merge`` the campaigns are shuffled to the buckets, by
    ``broadcast`` nothing is.
    """
    pairs = table.pairs().drop("restaurant_id")
    if cells is not None:
        pairs = pairs.where(F.col("cell").isin(cells))
    left = by_cell(campaigns, table)
    left = F.broadcast(left) if hint == "broadcast" else left.hint(hint)
    return left.join(pairs, "cell").drop("cell")


def laid_out_notifications(campaigns: DataFrame, size: Size, busiest: int, table: LaidOutFavourites, limits) -> DataFrame:
    """Notifications for measured campaigns that are cheap to read again, by the cheapest safe join.

    The campaigns' cells are listed only up to ``limits.pushed_ids`` of them.
    """
    listed = by_cell(campaigns, table).select("cell").distinct().limit(limits.pushed_ids + 1).collect()
    cells = [row.cell for row in listed] if len(listed) <= limits.pushed_ids else None
    fits = size.bytes * max(1, len(listed)) <= limits.broadcast_bytes and busiest <= limits.broadcast_fan_out
    if cells is not None:
        log.info("reading the buckets of %d cells", len(cells))
    return to_notifications(fan_out_by_cell(campaigns, table, cells, "broadcast" if fits else "merge"))
