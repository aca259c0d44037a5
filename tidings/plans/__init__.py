"""Whole queries: measure the campaigns, then pick the cheapest safe join."""

from tidings.plans.fanout import Limits, notifications, notify, notify_stream
from tidings.plans.heavy import heavy_restaurants
from tidings.plans.layout import LaidOutFavourites
from tidings.plans.splits import Cell
from tidings.plans.workspace import Workspace

__all__ = [
    "Cell",
    "LaidOutFavourites",
    "Limits",
    "Workspace",
    "heavy_restaurants",
    "notifications",
    "notify",
    "notify_stream",
]
