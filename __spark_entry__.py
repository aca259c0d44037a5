"""Queries over the test tables, and their SQL counterparts.

Campaigns come from ``events`` and favourites from ``lineitem`` and ``orders``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.operators import (
    active_at,
    dead_letters,
    decode_campaigns,
    dedupe_favourites,
    message_text,
    of_restaurants,
    stamp,
    to_messages,
    with_feedback,
)
from tidings.plans import LaidOutFavourites, Limits, Workspace, notify, notify_stream
from tidings.schemas import CAMPAIGN_COLUMNS, HEADER_COLUMNS, NOTIFICATION_COLUMNS
from tidings.session import in_utc
from tidings.sinks import files
from tidings.sources import star_schema
from tidings.sources.ranges import Bin, bins_sql, bounds_sql, ranges
from tidings.streaming import NotificationJob

try:
    import corpus_pipeline
    import tidings.llm.queries as training_data
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "tidings.llm", "tidings.llm.queries"):
        raise
    corpus_pipeline = training_data = None

NOW = 1704974400  # 2024-01-11 12:00:00 UTC


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return star_schema.table(in_utc(spark), folder, "events")


def _campaigns(spark: SparkSession, folder: str) -> DataFrame:
    return star_schema.campaigns(_events(spark, folder))


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return star_schema.messages(_events(spark, folder))


def _faulty(spark: SparkSession, folder: str) -> DataFrame:
    return star_schema.faulty_messages(_events(spark, folder))


def campaign_text(spark: SparkSession, folder: str) -> DataFrame:
    return message_text(_messages(spark, folder))


def campaign_decode(spark: SparkSession, folder: str) -> DataFrame:
    return decode_campaigns(_messages(spark, folder)).drop("message_id")


def campaign_malformed(spark: SparkSession, folder: str) -> DataFrame:
    return active_at(decode_campaigns(_faulty(spark, folder)), NOW).drop("message_id")


def campaign_dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    return dead_letters(decode_campaigns(_faulty(spark, folder), "payload"))


def campaign_active(spark: SparkSession, folder: str) -> DataFrame:
    return active_at(_campaigns(spark, folder), NOW).drop("message_id")


def campaign_stamp(spark: SparkSession, folder: str) -> DataFrame:
    return stamp(_campaigns(spark, folder), NOW).drop("message_id")


def favourites_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe_favourites(star_schema.favourites(in_utc(spark), folder))


def favourites_of_active(spark: SparkSession, folder: str) -> DataFrame:
    """Deduped before a join that may shuffle by the restaurant, and split busy ones."""
    restaurants = active_at(_campaigns(spark, folder), NOW).select("restaurant_id").distinct()
    return of_restaurants(dedupe_favourites(star_schema.favourites(spark, folder)), restaurants)


def favourites_in_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Read range by range of an id, as the connections to a database would."""
    rows = star_schema.numbered_favourites(in_utc(spark), folder)
    rows.createOrReplaceTempView("numbered_favourites")

    def count(low: int, high: int, width: int) -> list[Bin]:
        return [Bin(*row) for row in spark.sql(bins_sql("numbered_favourites", "id", low, high, width)).collect()]

    bounds = spark.sql(bounds_sql("numbered_favourites", "id")).first()
    parts = [rows.where(one) for one in ranges(tuple(bounds), count, 8, "id")]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _notify(spark: SparkSession, folder: str, limits: Limits = Limits()) -> DataFrame:
    favourites = star_schema.favourites(spark, folder)
    return notify(_campaigns(spark, folder), favourites, NOW, limits).drop("message_id")


def notification_fanout(spark: SparkSession, folder: str) -> DataFrame:
    return _notify(spark, folder)


def notification_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """The plan for campaigns too large to broadcast."""
    return _notify(spark, folder, Limits(broadcast_bytes=0))


def notification_laid_out(spark: SparkSession, folder: str) -> DataFrame:
    """From favourites that are kept bucketed."""
    laid_out = LaidOutFavourites.lay_out(star_schema.favourites(spark, folder), Workspace(spark))
    return notify(_campaigns(spark, folder), laid_out, NOW).drop("message_id")


def notification_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """From JSON messages."""
    campaigns = decode_campaigns(_messages(spark, folder))
    favourites = star_schema.favourites(spark, folder)
    return notify(campaigns, favourites, NOW).drop("message_id")


def notification_malformed(spark: SparkSession, folder: str) -> DataFrame:
    """From messages with faults; the incomplete ones give no notifications."""
    campaigns = decode_campaigns(_faulty(spark, folder))
    return notify(campaigns, star_schema.favourites(spark, folder), NOW).drop("message_id")


def notification_feedback(spark: SparkSession, folder: str) -> DataFrame:
    return with_feedback(_notify(spark, folder))


def notification_message(spark: SparkSession, folder: str) -> DataFrame:
    return to_messages(with_feedback(_notify(spark, folder)))


def notification_headers(spark: SparkSession, folder: str) -> DataFrame:
    """What names each message to its consumers."""
    campaigns = decode_campaigns(_messages(spark, folder))
    found = to_messages(with_feedback(notify(campaigns, star_schema.favourites(spark, folder), NOW)))
    named = F.map_from_entries("headers")
    return found.select("value", *(named[name].cast("string").alias(name) for name in HEADER_COLUMNS))


class _DiesOnce(files.FileSink):
    """A sink that is killed between its first batch's rows and their commit."""

    alive = False

    def commit(self, *batch) -> None:
        if not self.alive:
            self.alive = True
            raise RuntimeError("killed before the commit")
        super().commit(*batch)


def _stream(spark: SparkSession, folder: str, out: str, table: files.FileSink | None = None, laid_out: bool = False) -> None:
    """Run the streaming job over all of the table's files."""
    favourites = star_schema.favourites(spark, folder)
    if laid_out:
        favourites = LaidOutFavourites.lay_out(favourites, Workspace(spark))
    messages = star_schema.messages(star_schema.table_stream(in_utc(spark), folder, "events"))
    job = NotificationJob(
        favourites=lambda: favourites,
        table=table or files.parquet_table(f"{out}/table"),
        messages=files.text_messages(f"{out}/messages"),
        letters=files.parquet_letters(f"{out}/letters"),
        name=f"notifications_{out.rsplit('/', 1)[-1]}",
        now=NOW,
    )
    job.start(messages, f"{out}/checkpoint", {"availableNow": True}).awaitTermination()


def notification_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Table rows that the streaming job wrote."""
    out = Workspace(spark).path
    _stream(spark, folder, out)
    return files.read_table(spark, f"{out}/table")


def notification_stream_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that the streaming job wrote."""
    out = Workspace(spark).path
    _stream(spark, folder, out)
    return files.read_messages(spark, f"{out}/messages")


def notification_stream_replayed(spark: SparkSession, folder: str) -> DataFrame:
    """Table rows after a run that died between writing and committing them, and its repeat."""
    out = Workspace(spark).path
    whole = files.parquet_table(f"{out}/table")
    dying = _DiesOnce(whole.path, whole.form, whole.columns)
    try:
        _stream(spark, folder, out, dying)
    except StreamingQueryException:
        assert files.read_table(spark, f"{out}/table").isEmpty()
    _stream(spark, folder, out, dying)
    return files.read_table(spark, f"{out}/table")


def notification_stream_laid_out(spark: SparkSession, folder: str) -> DataFrame:
    """Table rows that the streaming job wrote from favourites that are kept bucketed."""
    out = Workspace(spark).path
    _stream(spark, folder, out, laid_out=True)
    return files.read_table(spark, f"{out}/table")


def notification_stream_static(spark: SparkSession, folder: str) -> DataFrame:
    """A stream joined to a table, without the job around it; busy restaurants of the table are cut."""
    out = Workspace(spark).path
    messages = star_schema.messages(star_schema.table_stream(in_utc(spark), folder, "events"))
    campaigns = stamp(active_at(decode_campaigns(messages), NOW), NOW)
    query = (
        notify_stream(campaigns, star_schema.favourites(spark, folder))
        .writeStream.format("parquet")
        .queryName(f"static_{out.rsplit('/', 1)[-1]}")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{out}/table")
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/table").select(*NOTIFICATION_COLUMNS)


def entry(spark: SparkSession) -> DataFrame:
    """Notifications for the campaigns active at ``NOW``."""
    return notification_fanout(spark, "/root/testdata/sf0.001")


def notification_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries of the campaigns and notifications."""
    return {
        query.__name__: query
        for query in (
            campaign_text,
            campaign_decode,
            campaign_malformed,
            campaign_dead_letters,
            campaign_active,
            campaign_stamp,
            favourites_dedupe,
            favourites_of_active,
            favourites_in_ranges,
            notification_fanout,
            notification_shuffled,
            notification_laid_out,
            notification_pipeline,
            notification_malformed,
            notification_feedback,
            notification_message,
            notification_headers,
            notification_stream,
            notification_stream_messages,
            notification_stream_replayed,
            notification_stream_laid_out,
            notification_stream_static,
        )
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each takes a session and the folder of the tables."""
    found = notification_queries()
    if training_data:
        found |= training_data.queries() | {"pipeline": corpus_pipeline.run}
    return found


def _json(columns: list[str], **changed: str) -> str:
    """SQL for a JSON object of the columns, in order."""
    fields = ", ".join(f"{name} := {changed.get(name, name)}" for name in columns)
    return f"CAST(to_json(struct_pack({fields})) AS VARCHAR)"


def oracle_sql() -> dict[str, str]:
    """The same results from SQL over the tables, where SQL can say them."""
    return notification_sql() | (training_data.oracle_sql() if training_data else {})


def notification_sql() -> dict[str, str]:
    """SQL for every query of the campaigns and notifications."""
    started = "CAST(floor(epoch(ts)) AS BIGINT)"
    campaigns = f"""
        SELECT event_id,
               CAST(user_id AS VARCHAR) AS restaurant_id,
               CAST(event_id AS VARCHAR) AS adv_campaign_id,
               event_type AS adv_campaign_content,
               'owner-' || user_id AS adv_campaign_owner,
               'owner-' || user_id || '@example.com' AS adv_campaign_owner_contact,
               {started} AS adv_campaign_datetime_start,
               {started} + 3600 * (1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 6)
                 AS adv_campaign_datetime_end,
               {started} - 72000 AS datetime_created
        FROM events"""
    pairs = """
        SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS client_id,
               CAST(l_suppkey AS VARCHAR) AS restaurant_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
    is_active = f"adv_campaign_datetime_start <= {NOW} AND adv_campaign_datetime_end > {NOW}"
    tables = f"WITH campaigns AS ({campaigns}), pairs AS ({pairs})"
    eight, ten = ", ".join(CAMPAIGN_COLUMNS), ", ".join(NOTIFICATION_COLUMNS)
    fanout = f"""
        SELECT c.*, client_id, CAST({NOW} AS INTEGER) AS trigger_datetime_created
        FROM campaigns c JOIN pairs USING (restaurant_id) WHERE {is_active}"""
    notifications = f"{tables} SELECT {ten} FROM ({fanout})"
    feedback = f"{tables} SELECT {ten}, CAST(NULL AS VARCHAR) AS feedback FROM ({fanout})"
    messages = f"{tables} SELECT {_json(NOTIFICATION_COLUMNS)} AS value FROM ({fanout})"
    without_owner = [name for name in CAMPAIGN_COLUMNS if name != "adv_campaign_owner"]
    quoted_start = {"adv_campaign_datetime_start": "CAST(adv_campaign_datetime_start AS VARCHAR)"}
    return {
        "campaign_text": f"""{tables}
            SELECT CAST(event_id AS VARCHAR) AS key, {_json(CAMPAIGN_COLUMNS)} AS value
            FROM campaigns""",
        "campaign_decode": f"{tables} SELECT {eight} FROM campaigns",
        "campaign_malformed": f"""{tables}
            SELECT * REPLACE (
                CASE WHEN adv_campaign_content <> 'purchase' THEN adv_campaign_owner END
                AS adv_campaign_owner)
            FROM (SELECT {eight} FROM campaigns
                  WHERE adv_campaign_content NOT IN ('error', 'signup') AND {is_active})""",
        "campaign_dead_letters": f"""{tables}
            SELECT 'campaigns:0:' || event_id AS message_id,
                   CASE adv_campaign_content
                     WHEN 'error' THEN 'not json ' || {_json(CAMPAIGN_COLUMNS)}
                     WHEN 'signup' THEN {_json(CAMPAIGN_COLUMNS, **quoted_start)}
                     ELSE {_json(without_owner)} END AS payload,
                   CASE adv_campaign_content
                     WHEN 'error' THEN '{",".join(CAMPAIGN_COLUMNS)}'
                     WHEN 'signup' THEN 'adv_campaign_datetime_start'
                     ELSE 'adv_campaign_owner' END AS missing_fields
            FROM campaigns WHERE adv_campaign_content IN ('error', 'signup', 'purchase')""",
        "campaign_active": f"{tables} SELECT {eight} FROM campaigns WHERE {is_active}",
        "campaign_stamp": f"""{tables}
            SELECT {eight}, CAST({NOW} AS INTEGER) AS trigger_datetime_created FROM campaigns""",
        "favourites_dedupe": pairs,
        "favourites_of_active": f"""{tables} SELECT client_id, restaurant_id FROM pairs
            WHERE restaurant_id IN (SELECT restaurant_id FROM campaigns WHERE {is_active})""",
        "favourites_in_ranges": """
            SELECT CAST(l_orderkey AS BIGINT) * 8 + l_linenumber
                   + CASE WHEN l_orderkey % 3 = 0 THEN 1000000000000 ELSE 0 END AS id,
                   CAST(o_custkey AS VARCHAR) AS client_id, CAST(l_suppkey AS VARCHAR) AS restaurant_id
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        "notification_fanout": notifications,
        "notification_shuffled": notifications,
        "notification_laid_out": notifications,
        "notification_pipeline": notifications,
        "notification_malformed": f"""{notifications}
            WHERE adv_campaign_content NOT IN ('error', 'signup', 'purchase')""",
        "notification_feedback": feedback,
        "notification_message": messages,
        "notification_headers": f"""{tables}
            SELECT {_json(NOTIFICATION_COLUMNS)} AS value, 'campaigns:0:' || event_id AS message_id, client_id
            FROM ({fanout})""",
        "notification_stream": feedback,
        "notification_stream_messages": messages,
        "notification_stream_replayed": feedback,
        "notification_stream_laid_out": feedback,
        "notification_stream_static": notifications,
    }
