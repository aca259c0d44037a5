"""The favourites table: which client likes which restaurant."""

from pyspark.sql import DataFrame

from tidings.schemas import FAVOURITE_COLUMNS


def dedupe_favourites(favourites: DataFrame) -> DataFrame:
    """One row per (client, restaurant).

    Copies collapse in the map-side half of the aggregate, so neither many copies
    of one pair nor many clients of one restaurant end up in one task.
    """
    return favourites.select(*FAVOURITE_COLUMNS).dropDuplicates()


def of_restaurants(favourites: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Favourites of the given restaurants.

    Catalyst does not derive this from an inner join above the dedupe. Use it below
    the dedupe only with restaurants that are broadcast: after a shuffle by the
    restaurant the dedupe would keep that partitioning, a busy restaurant in one task.
    """
    return favourites.join(restaurants.select("restaurant_id"), "restaurant_id", "left_semi")
