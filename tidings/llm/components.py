"""Connected components of links between ids, by alternating stars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.plans import Workspace


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("l")).select("l.u", "l.v")


def _large_star(links: DataFrame) -> DataFrame:
    """Hang each id's larger neighbours on the least id among it and its neighbours."""
    ways = _both_ways(links)
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Hang each id and its smaller neighbours on the least of them; links point down."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, room: Workspace) -> DataFrame:
    """``u`` and ``root``, the least id it is linked with over any number of links, unless that is itself.

    ``links`` has columns u and v of one type, numbers or texts, whose order names the least. Every round is a written table, so a lost
    executor costs at most one round; rounds grow with the logarithm of a component's
    size. A hub's rows are only joined and counted, never gathered in one task. Nulls
    and links of an id with itself link nothing; repeated links count once.
    """
    name = uuid.uuid4().hex[:8]
    clean = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state, before = room.hold(clean, f"links-{name}-0"), None
    number = 0
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return state.select("u", F.col("v").alias("root"))
        before = mark
        number += 1
        state = room.hold(_small_star(_large_star(state)), f"links-{name}-{number}")
