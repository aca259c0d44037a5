"""From campaigns and favourites to notifications."""

import logging
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidings.functions.bloom import Bloom, blocks_for
from tidings.operators import (
    active_at,
    dedupe_favourites,
    fan_out,
    fan_out_split,
    of_restaurants,
    sendable,
    stamp,
    to_notifications,
)
from tidings.plans.heavy import heavy_restaurants
from tidings.plans.layout import LaidOutFavourites, fan_out_by_cell, laid_out_notifications
from tidings.plans.measure import Size, Tally, tally
from tidings.plans.splits import Cell, splits
from tidings.plans.workspace import Workspace

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Limits:
    """Measured sizes up to which a cheaper plan is taken; none limits the result."""

    # Largest side to broadcast, and most campaigns of one restaurant in it.
    broadcast_bytes: int = 64 << 20
    broadcast_fan_out: int = 100
    # Most restaurant ids to hand to the favourites' scan as an IN list.
    pushed_ids: int = 200
    # Largest filter of restaurant ids to broadcast, where the ids themselves are too many.
    bloom_bytes: int = 64 << 20
    # Rows of one restaurant up to which it is not cut.
    cell: Cell = Cell()
    # Input of a join task, when Spark's own number of partitions is too small.
    partition_bytes: int = 256 << 20


def notify(
    campaigns: DataFrame,
    favourites: DataFrame | LaidOutFavourites,
    now: int | None = None,
    limits: Limits = Limits(),
    workspace: Workspace | None = None,
) -> DataFrame:
    """Notifications for the campaigns that run at ``now``; both sides bounded.

    Campaigns that lack a required field give none, as in the streaming job.

    Runs jobs: the active campaigns, few of all, are written once, so that the
    measuring and the join do not read and decode every message again. The result
    reads what was written; give a workspace to clear it afterwards.
    """
    workspace = workspace or Workspace(campaigns.sparkSession)
    active = stamp(sendable(active_at(campaigns, now)), now)
    metrics = Observation()
    active = workspace.hold(active.observe(metrics, *Size.metrics(active)), "campaigns")
    return notifications(active, Size.observed(metrics), favourites, workspace, limits)


def notifications(
    campaigns: DataFrame,
    size: Size,
    favourites: DataFrame | LaidOutFavourites,
    workspace: Workspace,
    limits: Limits = Limits(),
) -> DataFrame:
    """Notifications for ``size`` active campaigns that are cheap to read again."""
    seen = tally(campaigns, size)
    if isinstance(favourites, LaidOutFavourites):
        return laid_out_notifications(campaigns, size, seen.busiest, favourites, limits)
    pairs = dedupe_favourites(_relevant(favourites, campaigns, seen, limits))
    if size.bytes <= limits.broadcast_bytes and seen.busiest <= limits.broadcast_fan_out:
        log.info("broadcasting %d campaigns of %d restaurants", size.rows, seen.restaurants)
        return to_notifications(fan_out(F.broadcast(campaigns), pairs))

    metrics = Observation()
    pairs = workspace.hold(pairs.observe(metrics, *Size.metrics(pairs)), "favourites")
    clients = Size.observed(metrics)
    cells = max(
        int(campaigns.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        ceil((size.bytes + clients.bytes) / limits.partition_bytes),
    )
    busy = splits(campaigns, size, pairs, clients, workspace, limits.cell, cells)
    log.info("shuffling %d campaigns and %d favourites", size.rows, clients.rows)
    return to_notifications(fan_out_split(campaigns, pairs, busy, cells))


def _relevant(
    favourites: DataFrame, campaigns: DataFrame, seen: Tally, limits: Limits
) -> DataFrame:
    """Favourites cut down to the campaigns' restaurants, where that is cheap."""
    if seen.ids is not None and len(seen.ids) <= limits.pushed_ids:
        return favourites.filter(F.col("restaurant_id").isin(seen.ids))
    if seen.id_bytes <= limits.broadcast_bytes:
        restaurants = campaigns.select("restaurant_id").distinct()
        return of_restaurants(favourites, F.broadcast(restaurants))
    blocks = blocks_for(seen.restaurants, limits.bloom_bytes)
    if blocks is None:
        log.info("%d restaurants are too many for a filter", seen.restaurants)
        return favourites
    log.info("filtering favourites by %d blocks for %d restaurants", blocks, seen.restaurants)
    return Bloom.of(campaigns, "restaurant_id", blocks).maybe(favourites)


def notify_stream(
    campaigns: DataFrame, favourites: DataFrame | LaidOutFavourites, cells: int | None = None, cell: Cell = Cell()
) -> DataFrame:
    """Notifications for a stream of active campaigns by a join in the streaming plan itself.

    Unlike in a micro-batch of ``NotificationJob``, campaigns can't be measured here. The favourites can: the busy
    restaurants among them are found when the plan is made, and their clients are cut into
    parts, over which a campaign is repeated. Restaurants that get busy later are joined whole, with the same
    result. Laid-out favourites are cut already, and aren't shuffled.
    """
    if isinstance(favourites, LaidOutFavourites):
        return to_notifications(fan_out_by_cell(campaigns, favourites))
    spark = favourites.sparkSession
    cells = cells or int(spark.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_restaurants(favourites, cells, cell)
    log.info("cutting %d busy restaurants", heavy.restaurants)
    return to_notifications(fan_out_split(campaigns, dedupe_favourites(favourites), heavy.splits, cells))
