"""Restaurants that many users like, from a mergeable sketch of the favourites."""

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.plans.splits import SPLIT_SCHEMA, Cell

# Restaurants that a sketch tracks for each share to be told; its error is then below half a share.
TRACKED_PER_SHARE = 8
MOST_TRACKED = 1_000_000
MOST_TOLD = 100_000


@dataclass(frozen=True)
class Heavy:
    """``splits`` as for ``fan_out_split``; ``rows`` counts the favourites with their copies."""

    splits: DataFrame
    rows: int
    restaurants: int


def heavy_restaurants(favourites: DataFrame, cells: int, cell: Cell = Cell()) -> Heavy:
    """The restaurants with more favourites than one of ``cells`` equal shares, and the parts to cut them into.

    One scan, and one row from each task: tasks keep a sketch of the most frequent restaurants, and
    sketches are merged, so no restaurant's rows meet anywhere. A restaurant above a share
    is always told. Counts are estimates and only decide how finely to cut: what is joined doesn't
    depend on them. Fewer than ``cells`` restaurants exceed a share, so the list is short.
    """
    cells = max(1, min(cells, MOST_TOLD // 2))
    told = 2 * cells
    tracked = min(MOST_TRACKED, max(TRACKED_PER_SHARE * cells, told))
    known = favourites.where("restaurant_id IS NOT NULL")
    found = known.agg(
        F.count("*").alias("rows"),
        F.call_function("approx_top_k", F.col("restaurant_id"), F.lit(told), F.lit(tracked)).alias("top"),
    ).first()
    share = max(cell.favourites, ceil(found.rows / cells))
    busy = [(one.item, ceil(one["count"] / share), 1) for one in found.top or () if one["count"] > share]
    return Heavy(favourites.sparkSession.createDataFrame(busy, SPLIT_SCHEMA), found.rows, len(busy))
