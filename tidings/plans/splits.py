"""How to cut the busy restaurants for ``fan_out_split``."""

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidings.plans.measure import Size, per_restaurant
from tidings.plans.workspace import Workspace

SPLIT_SCHEMA = "restaurant_id string, client_parts int, campaign_parts int"


@dataclass(frozen=True)
class Cell:
    """Rows that one join task takes of one restaurant, in and out."""

    campaigns: int = 100
    favourites: int = 10_000
    notifications: int = 100_000

    def parts(self, campaigns: int, favourites: int) -> tuple[int, int]:
        """Parts to cut a restaurant's clients and campaigns into."""
        client_parts = max(1, ceil(favourites / self.favourites))
        campaign_parts = max(1, ceil(campaigns / self.campaigns))
        out = ceil(favourites / client_parts) * ceil(campaigns / campaign_parts)
        return ceil(client_parts * max(1, out / self.notifications)), campaign_parts


def splits(
    campaigns: DataFrame,
    campaign_size: Size,
    favourites: DataFrame,
    favourite_size: Size,
    workspace: Workspace,
    least: Cell,
    cells: int,
) -> DataFrame:
    """The busy restaurants and their parts.

    A cell takes what ``least`` says or one of ``cells`` equal shares, whichever is
    more, and a restaurant is busy when it exceeds that in campaigns, favourites or
    notifications. By each of the three fewer than ``cells`` restaurants can, so the
    list stays below three times that: short enough for the driver and a broadcast.
    """
    counts = (
        per_restaurant(campaigns, "campaigns")
        .join(per_restaurant(favourites, "favourites"), "restaurant_id", "full")
        .fillna(0, ["campaigns", "favourites"])
    )
    notifications = F.col("campaigns").cast("double") * F.col("favourites")
    observed = Observation()
    loads = workspace.hold(
        counts.observe(observed, F.sum(notifications).alias("notifications")), "loads"
    )
    cell = Cell(
        max(least.campaigns, ceil(campaign_size.rows / cells)),
        max(least.favourites, ceil(favourite_size.rows / cells)),
        max(least.notifications, ceil((observed.get.get("notifications") or 0) / cells)),
    )
    busy = loads.filter(
        (F.col("campaigns") > cell.campaigns)
        | (F.col("favourites") > cell.favourites)
        | (notifications > cell.notifications)
    ).collect()
    rows = [(row.restaurant_id, *cell.parts(row.campaigns, row.favourites)) for row in busy]
    return loads.sparkSession.createDataFrame(rows, SPLIT_SCHEMA)
