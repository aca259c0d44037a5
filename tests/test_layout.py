"""Laid-out favourites, busy restaurants of a stream's static side, and the filter of ids."""

import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from samples import plan_of
from test_plans import CAMPAIGNS, HOT_CAMPAIGNS, HOT_PAIRS, PAIRS, brute_force, campaigns, found

from tidings.functions.bloom import BLOCK_BYTES, Bloom, blocks_for
from tidings.operators import dedupe_favourites
from tidings.operators.fanout import to_notifications
from tidings.plans import Cell, LaidOutFavourites, Limits, Workspace, heavy_restaurants, notify, notify_stream
from tidings.plans.layout import fan_out_by_cell

SMALL = Cell(favourites=10)


@pytest.fixture(scope="module")
def skewed(spark):
    """Of 6,000 favourites 2,000 are of one restaurant, 300 are copies, and one has no restaurant."""
    rows = [(f"u{at}", "busy") for at in range(2000)]
    rows += [(f"u{at % 700}", f"r{at % 101}") for at in range(3700)]
    rows += [("u1", "r1")] * 299 + [("u1", None)]
    return spark.createDataFrame(rows, PAIRS).repartition(5), rows


@pytest.mark.parametrize("cell", [Cell(), SMALL])
def test_laid_out_favourites_give_the_same_rows(spark, skewed, cell):
    favourites, rows = skewed
    table = LaidOutFavourites.lay_out(favourites, Workspace(spark), 8, cell)
    assert (table.splits().count() > 0) == (cell is SMALL)
    assert Counter(map(tuple, table.pairs().select("client_id", "restaurant_id").collect())) == Counter(set(rows))
    offers = ["busy"] * 3 + ["r1", "r2", "r500", None]
    for limits in (Limits(), Limits(pushed_ids=0), Limits(broadcast_bytes=0), Limits(broadcast_bytes=0, pushed_ids=0)):
        result = notify(campaigns(spark, offers), table, 5, limits)
        assert found(result) == brute_force(offers, rows)
    table.drop()


def test_only_the_campaigns_buckets_are_read_and_nothing_is_shuffled(spark, skewed):
    favourites, rows = skewed
    table = LaidOutFavourites.lay_out(favourites, Workspace(spark), 32)
    offers = campaigns(spark, ["r1", "r2", "r2"])
    # Spark prunes buckets also where it doesn't need them for a join, but shows them only where it keeps them.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = plan_of(notify(offers, table, 5))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    selected = re.search(r"SelectedBucketsCount: (\d+) out of 32", plan)
    assert selected and int(selected[1]) <= 2
    assert "BroadcastHashJoin" in plan and not re.search(r"Exchange hashpartitioning", plan)
    # Without a broadcast the campaigns go to the buckets; the favourites stay where they are.
    merged = plan_of(notify(offers, table, 5, Limits(broadcast_bytes=0, pushed_ids=0)))
    assert "SortMergeJoin" in merged
    assert merged.count("Exchange hashpartitioning") == 1
    assert merged.index("SortMergeJoin") < merged.index("Exchange hashpartitioning") < merged.index("Bucketed: true")
    assert "Exchange" not in merged[merged.rindex("Sort [cell") :]
    table.drop()


def test_no_bucket_holds_a_busy_restaurant_whole(spark, skewed):
    favourites, _ = skewed
    table = LaidOutFavourites.lay_out(favourites, Workspace(spark), 16, SMALL)
    per_bucket = [row["count"] for row in table.pairs().groupBy(F.input_file_name()).count().collect()]
    distinct = table.pairs().count()
    busy = table.pairs().where("restaurant_id = 'busy'").groupBy("cell").count().collect()
    assert len(busy) >= 15 and max(row["count"] for row in busy) <= distinct / 16
    assert len(per_bucket) == 16 and max(per_bucket) <= 2.5 * distinct / 16
    table.drop()


def test_laid_out_favourites_of_nothing(spark, skewed):
    favourites, rows = skewed
    empty = LaidOutFavourites.lay_out(favourites.limit(0), Workspace(spark), 4)
    assert notify(campaigns(spark, ["r1"]), empty, 5).collect() == []
    table = LaidOutFavourites.lay_out(favourites, Workspace(spark), 4)
    assert notify(spark.createDataFrame([], CAMPAIGNS), table, 5).collect() == []


def test_stream_reads_the_newest_layout(spark, folder, query_name):
    """A table laid out anew is seen by the next batch; the old one stays readable meanwhile."""
    from samples import messages, payload

    from tidings.sinks import files
    from tidings.sources import file_campaign_stream
    from tidings.streaming import NotificationJob

    liked = [("a", "r1")]
    newest = []

    def lay_out():
        newest.append(LaidOutFavourites.lay_out(spark.createDataFrame(liked, PAIRS), Workspace(spark), 4))
        return newest[-1]

    sinks = {"table": files.parquet_table(f"{folder}/t"), "messages": files.text_messages(f"{folder}/m"), "letters": files.parquet_letters(f"{folder}/l")}
    job = NotificationJob(favourites=lay_out, name=query_name, now=50, **sinks)
    for name in ("one", "two"):
        messages(spark, [payload(campaign=name)]).select("key", "value").write.mode("append").parquet(f"{folder}/in")
        job.start(file_campaign_stream(spark, f"{folder}/in"), f"{folder}/checkpoint", {"availableNow": True}).awaitTermination()
        liked.append(("b", "r1"))
    rows = {(row.adv_campaign_id, row.client_id) for row in files.read_table(spark, f"{folder}/t").collect()}
    assert rows == {("one", "a"), ("two", "a"), ("two", "b")}
    assert newest[0].pairs().count() == 1


def test_heavy_restaurants_are_found_by_their_share(spark, skewed):
    favourites, rows = skewed
    heavy = heavy_restaurants(favourites, 16, SMALL)
    assert heavy.rows == len([one for one in rows if one[1]])
    assert [tuple(row) for row in heavy.splits.collect()] == [("busy", 6, 1)]
    assert heavy_restaurants(favourites, 16).restaurants == 0  # no more than one task takes anyway
    assert heavy_restaurants(favourites.limit(0), 16).restaurants == 0


def test_heavy_restaurants_among_many(spark):
    """A sketch of bounded size over far more restaurants tells every one above a share."""
    light = spark.range(60_000).select(F.col("id").cast("string").alias("client_id"), F.concat(F.lit("r"), F.col("id") % 30_000).alias("restaurant_id"))
    busy = spark.range(40_000).select(F.col("id").cast("string").alias("client_id"), F.concat(F.lit("busy"), F.col("id") % 4).alias("restaurant_id"))
    heavy = heavy_restaurants(light.unionByName(busy).repartition(7), 20, SMALL)
    assert {row.restaurant_id for row in heavy.splits.collect()} >= {f"busy{at}" for at in range(4)}
    assert heavy.restaurants < 20


def test_stream_static_join_cuts_busy_restaurants(spark, skewed):
    """With a third of the favourites in one restaurant no task makes more than its share."""
    favourites, rows = skewed
    offers = ["busy"] * 20 + [f"r{at}" for at in range(20)]
    stamped = campaigns(spark, offers).withColumn("trigger_datetime_created", F.lit(5))
    joined = notify_stream(stamped, favourites, 16, SMALL)
    assert found(joined) == brute_force(offers, rows)
    per_task = [row["count"] for row in joined.groupBy(F.spark_partition_id()).count().collect()]
    whole = to_notifications(stamped.repartition(16, "restaurant_id").join(dedupe_favourites(favourites).repartition(16, "restaurant_id").hint("merge"), "restaurant_id"))
    uncut = [row["count"] for row in whole.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == sum(uncut)
    assert max(uncut) >= 0.9 * sum(uncut)
    assert max(per_task) <= 0.35 * sum(per_task)


@pytest.mark.parametrize("laid_out", [False, True])
def test_stream_static_join_in_a_stream(spark, skewed, folder, query_name, laid_out):
    favourites, rows = skewed
    offers = ["busy"] * 3 + ["r1", "r500"]
    campaigns(spark, offers).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(campaigns(spark, offers).schema).parquet(f"{folder}/in").withColumn("trigger_datetime_created", F.lit(5))
    static = LaidOutFavourites.lay_out(favourites, Workspace(spark), 8, SMALL) if laid_out else favourites
    query = (
        notify_stream(stream, static, 8, SMALL)
        .writeStream.format("parquet")
        .queryName(query_name)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/out")
    )
    query.awaitTermination()
    assert found(spark.read.parquet(f"{folder}/out")) == brute_force(offers, rows)


@pytest.mark.parametrize("cell", [Cell(), SMALL])
def test_hot_pairs_by_cell(spark, cell):
    table = LaidOutFavourites.lay_out(spark.createDataFrame(HOT_PAIRS, PAIRS), Workspace(spark), 4, cell)
    for hint in ("broadcast", "merge", "shuffle_hash"):
        assert found(fan_out_by_cell(campaigns(spark, HOT_CAMPAIGNS), table, hint=hint)) == brute_force(HOT_CAMPAIGNS, HOT_PAIRS)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.text(max_size=4), max_size=20), st.sets(st.text(max_size=4), max_size=20), st.integers(1, 3))
def test_filter_keeps_every_id_it_was_built_from(spark, held, others, blocks):
    ids = spark.createDataFrame([(one,) for one in [*held, None]], "restaurant_id string")
    rows = spark.createDataFrame([(one,) for one in held | others], "restaurant_id string")
    kept = {row.restaurant_id for row in Bloom.of(ids, "restaurant_id", blocks).maybe(rows).collect()}
    assert held <= kept <= held | others


def test_filter_is_sized_by_its_ids_and_its_room(spark):
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("restaurant_id"))
    blocks = blocks_for(20_000, 64 << 20)
    other = spark.range(20_000, 120_000).select(F.col("id").cast("string").alias("restaurant_id"))
    made = Bloom.of(ids, "restaurant_id", blocks)
    assert made.table.count() <= blocks
    assert made.maybe(other).count() < 0.03 * 100_000
    assert made.maybe(ids).count() == 20_000
    assert blocks_for(20_000, blocks * BLOCK_BYTES) == blocks
    assert blocks_for(20_000, blocks * BLOCK_BYTES // 2) == blocks // 2  # fewer bits, more others
    assert blocks_for(20_000, blocks * BLOCK_BYTES // 10) is None
    assert blocks_for(0, 1000) == 1


def test_many_restaurants_are_filtered_before_the_dedupe(spark, skewed):
    """Where the ids are too many to broadcast, a filter of them isn't: fewer favourites are shuffled, rows are equal."""
    favourites, rows = skewed
    offers = [f"r{at}" for at in range(30)]
    base = Limits(broadcast_bytes=0, pushed_ids=0)
    result = notify(campaigns(spark, offers), favourites, 5, base)
    assert found(result) == brute_force(offers, rows)
    unfiltered = notify(campaigns(spark, offers), favourites, 5, Limits(broadcast_bytes=0, pushed_ids=0, bloom_bytes=0))
    assert found(unfiltered) == brute_force(offers, rows)
    from tidings.plans.fanout import _relevant
    from tidings.plans.measure import Size, tally

    side = campaigns(spark, offers)
    seen = tally(side, Size(len(offers), 10_000))
    kept = _relevant(favourites, side, seen, base)
    assert "BroadcastHashJoin" in plan_of(kept) and "LeftSemi" in plan_of(kept)
    assert kept.count() < 0.5 * favourites.count()
    assert _relevant(favourites, side, seen, Limits(broadcast_bytes=0, pushed_ids=0, bloom_bytes=0)) is favourites
