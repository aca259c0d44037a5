"""Campaigns to notifications: one row per (campaign message, client)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.schemas import MESSAGE_ID, NOTIFICATION_COLUMNS


def fan_out(campaigns: DataFrame, favourites: DataFrame) -> DataFrame:
    """Inner join on the restaurant; ``campaigns`` may be a stream."""
    return campaigns.join(favourites, "restaurant_id")


def fan_out_split(
    campaigns: DataFrame, favourites: DataFrame, splits: DataFrame, partitions: int
) -> DataFrame:
    """``fan_out`` with the busy restaurants cut into cells.

    ``splits`` gives, for each busy restaurant, the parts to cut its clients and
    its campaigns into. Each side is hashed into its own parts and repeated over
    the other side's, so every (campaign, client) meets in exactly one cell.
    Restaurants not listed stay whole.

    The cells go to a fixed number of partitions: adaptive execution would merge
    them by their input size, which says nothing about a fan-out's output.
    """
    splits = F.broadcast(splits)  # bounded by whoever made it, see plans.splits
    client_parts = F.coalesce("client_parts", F.lit(1))
    campaign_parts = F.coalesce("campaign_parts", F.lit(1))
    campaign_key = [MESSAGE_ID] if MESSAGE_ID in campaigns.columns else campaigns.columns

    def part_of(key: list[str], parts):
        return F.pmod(F.xxhash64(*key), parts).cast("int")

    def every(parts):
        return F.explode(F.sequence(F.lit(0), parts - 1))

    left = campaigns.join(splits, "restaurant_id", "left").select(
        *campaigns.columns,
        part_of(campaign_key, campaign_parts).alias("_campaign_part"),
        every(client_parts).alias("_client_part"),
    )
    right = favourites.join(splits, "restaurant_id", "left").select(
        *favourites.columns,
        part_of(["client_id"], client_parts).alias("_client_part"),
        every(campaign_parts).alias("_campaign_part"),
    )
    cell = ["restaurant_id", "_client_part", "_campaign_part"]
    joined = left.repartition(partitions, *cell).join(
        right.repartition(partitions, *cell).hint("merge"), cell
    )
    return joined.drop("_client_part", "_campaign_part")


def to_notifications(joined: DataFrame) -> DataFrame:
    """The ten notification columns, after the message id if there is one."""
    carried = [MESSAGE_ID] if MESSAGE_ID in joined.columns else []
    return joined.select(*carried, *NOTIFICATION_COLUMNS)
