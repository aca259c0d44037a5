"""Operators one by one: decode, active window, dedupe, fan-out, output."""

import json

import pytest
from pyspark.sql import functions as F
from samples import (
    CAMPAIGN,
    FAVOURITES,
    GOLDEN,
    GOLDEN_NOW,
    Listed,
    bag,
    favourites,
    messages,
    payload,
    plan_of,
)

from tidings.functions.clock import instant
from tidings.operators import (
    active_at,
    dead_letters,
    decode_campaigns,
    dedupe_favourites,
    fan_out,
    message_text,
    of_restaurants,
    stamp,
    to_messages,
    to_notifications,
    with_feedback,
)
from tidings.plans import Limits, notify
from tidings.schemas import (
    CAMPAIGN_COLUMNS,
    CAMPAIGN_SCHEMA,
    FEEDBACK_COLUMNS,
    NOTIFICATION_COLUMNS,
)

SHUFFLED = Limits(broadcast_bytes=0)


def golden_message(spark):
    return messages(spark, [json.dumps(dict(zip(CAMPAIGN_COLUMNS, CAMPAIGN)))])


def campaigns(spark, *windows):
    rows = [("r1", f"c{i}", "x", "x", "x", start, end, 0) for i, (start, end) in enumerate(windows)]
    return spark.createDataFrame(rows, CAMPAIGN_SCHEMA)


@pytest.mark.parametrize("limits", [Limits(), SHUFFLED])
def test_golden(spark, limits):
    found = notify(
        decode_campaigns(golden_message(spark)), favourites(spark), GOLDEN_NOW, limits
    ).drop("message_id")
    assert found.columns == NOTIFICATION_COLUMNS
    assert dict(found.dtypes)["trigger_datetime_created"] == "int"
    assert bag(found) == bag(Listed(GOLDEN))


def test_key_and_value_as_text(spark):
    (row,) = message_text(messages(spark, ["tekst Ж"])).collect()
    assert (row.key, row.value) == ("key", "tekst Ж")


WHOLE = ("r1", "c1", "content", "owner", "contact", 1, 100, 0)
NOTHING = (None,) * 8


@pytest.mark.parametrize(
    ("text", "decoded"),
    [
        (payload(), WHOLE),
        (payload(more=1), WHOLE),
        ("no json", NOTHING),
        ("", NOTHING),
        (None, NOTHING),
        (payload(adv_campaign_datetime_start=...), (*WHOLE[:5], None, 100, 0)),
        (payload(adv_campaign_datetime_end=...), (*WHOLE[:6], None, 0)),
        (payload(restaurant_id=...), (None, *WHOLE[1:])),
        (payload(adv_campaign_owner=...), (*WHOLE[:3], None, *WHOLE[4:])),
        (payload(start="1"), (*WHOLE[:5], None, 100, 0)),
        (payload(start=1.5), (*WHOLE[:5], None, 100, 0)),
        (payload(start=1.0), (*WHOLE[:5], None, 100, 0)),
        (payload().replace('start": 1', 'start": 1e3'), (*WHOLE[:5], None, 100, 0)),
        (payload(end=2**63), (*WHOLE[:6], None, 0)),
        (payload(restaurant=7), ("7", *WHOLE[1:])),
        (payload(restaurant={"a": 1}), ('{"a":1}', *WHOLE[1:])),
        (f"[{payload()}]", NOTHING),
        (payload().replace("restaurant_id", "RESTAURANT_ID"), (None, *WHOLE[1:])),
        (payload() + " and more", WHOLE),
    ],
)
def test_decode(spark, text, decoded):
    (row,) = decode_campaigns(messages(spark, [text])).collect()
    assert row == ("m0", *decoded)
    (row,) = decode_campaigns(messages(spark, [text]), "raw").collect()
    assert row == ("m0", *decoded, text if None in decoded else None)


def test_decode_reads_each_payload_once(spark, folder):
    """The filter stays above the parser: no second parse per predicate."""
    messages(spark, [payload()]).write.parquet(folder + "/in")
    found = active_at(decode_campaigns(spark.read.parquet(folder + "/in")), 50)
    plan = plan_of(found)
    assert plan.count("from_json(") == 1
    assert "key" not in plan.split("ReadSchema: ")[1].splitlines()[0]


def test_decode_without_message_id(spark):
    found = decode_campaigns(messages(spark, [payload()]).select("key", "value"))
    assert found.columns == CAMPAIGN_COLUMNS


def test_dead_letters(spark):
    texts = [payload(), "no json", None, payload(start="1", adv_campaign_owner=...)]
    found = dead_letters(decode_campaigns(messages(spark, texts), "payload"))
    every = ",".join(CAMPAIGN_COLUMNS)
    assert sorted(map(tuple, found.collect()), key=lambda row: row[0]) == [
        ("m1", "no json", every),
        ("m2", None, every),
        ("m3", texts[3], "adv_campaign_owner,adv_campaign_datetime_start"),
    ]


def test_active_window(spark):
    windows = [(5, 6), (1, 5), (6, 9), (None, 9), (1, None), (1, 9)]
    found = active_at(campaigns(spark, *windows), 5)
    assert {r.adv_campaign_id for r in found.collect()} == {"c0", "c5"}


def test_clock(spark):
    row = spark.range(1).select(
        instant().alias("now"),
        instant(5).alias("given"),
        instant(F.lit(7)).alias("column"),
        F.unix_timestamp().alias("spark"),
    )
    (row,) = row.collect()
    assert row.now == row.spark and (row.given, row.column) == (5, 7)


def test_stamp(spark):
    found = stamp(campaigns(spark, (1, 9)), 5)
    assert found.dtypes[-1] == ("trigger_datetime_created", "int")
    assert found.first().trigger_datetime_created == 5
    assert stamp(campaigns(spark, (1, 9))).first().trigger_datetime_created > 1_700_000_000


def test_dedupe(spark):
    found = dedupe_favourites(favourites(spark, [*FAVOURITES, (11, None, None), (12, None, None)]))
    assert found.columns == ["client_id", "restaurant_id"]
    assert found.count() == 10


def test_dedupe_combines_before_its_only_shuffle(spark, folder):
    favourites(spark).write.parquet(folder + "/in")
    found = dedupe_favourites(spark.read.parquet(folder + "/in"))
    plan = plan_of(found)
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2
    assert "ReadSchema: struct<client_id:string,restaurant_id:string>" in plan


def test_of_restaurants(spark):
    wanted = spark.createDataFrame([(FAVOURITES[7][2],), ("x",)], "restaurant_id string")
    found = of_restaurants(favourites(spark), wanted)
    assert sorted(r.id for r in found.collect()) == [8, 9]


def test_fan_out(spark):
    offered = campaigns(spark, (1, 9)).union(campaigns(spark, (1, 9)))
    liked = spark.createDataFrame(
        [("a", "r1"), ("b", "r1"), ("c", "r2"), ("d", None)],
        "client_id string, restaurant_id string",
    )
    found = to_notifications(fan_out(stamp(offered, 5), liked))
    assert found.columns == NOTIFICATION_COLUMNS
    assert sorted(r.client_id for r in found.collect()) == ["a", "a", "b", "b"]
    unknown = offered.withColumn("restaurant_id", F.lit(None).cast("string"))
    assert fan_out(unknown, liked).isEmpty()


def test_feedback_and_message(spark):
    found = with_feedback(spark.createDataFrame(GOLDEN[:1], _notification_schema()))
    assert found.columns == FEEDBACK_COLUMNS
    assert found.dtypes[-1] == ("feedback", "string")
    assert found.first().feedback is None
    (message,) = to_messages(found.withColumn("message_id", F.lit("m0"))).collect()
    assert json.loads(message.value) == dict(zip(NOTIFICATION_COLUMNS, GOLDEN[0]))
    assert list(json.loads(message.value)) == NOTIFICATION_COLUMNS


def _notification_schema():
    return CAMPAIGN_SCHEMA.simpleString()[7:-1].replace(":", " ") + (
        ", client_id string, trigger_datetime_created int"
    )
