"""What the campaigns measure, before a join is chosen for them."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidings.functions.sizes import row_bytes

FEW_ROWS = 1000  # a side of so many rows is counted on the driver


@dataclass(frozen=True)
class Size:
    """Rows of a side, and an upper estimate of its bytes."""

    rows: int
    bytes: int

    @staticmethod
    def metrics(side: DataFrame) -> list[Column]:
        return [F.count("*").alias("rows"), F.sum(row_bytes(side)).alias("bytes")]

    @classmethod
    def observed(cls, metrics: Observation) -> "Size":
        got = metrics.get
        return cls(got.get("rows") or 0, got.get("bytes") or 0)


@dataclass(frozen=True)
class Tally:
    """The restaurants of a side."""

    restaurants: int = 0
    id_bytes: int = 0
    busiest: int = 0  # most rows of one restaurant
    ids: list[str] | None = None  # all of them, on a side of few rows


def tally(side: DataFrame, size: Size) -> Tally:
    """Count a side of the given size by restaurant, in one job."""
    counts = per_restaurant(side, "rows")
    if size.rows <= FEW_ROWS:
        rows = {row.restaurant_id: row.rows for row in counts.collect()}
        return Tally(len(rows), size.bytes, max(rows.values(), default=0), list(rows))
    totals = counts.agg(
        F.count("*").alias("restaurants"),
        F.sum(row_bytes(side.select("restaurant_id"))).alias("id_bytes"),
        F.max("rows").alias("busiest"),
    ).first()
    return Tally(**totals.asDict())


def per_restaurant(side: DataFrame, name: str) -> DataFrame:
    """The number of a side's rows for each restaurant."""
    return side.groupBy("restaurant_id").agg(F.count("*").alias(name))
