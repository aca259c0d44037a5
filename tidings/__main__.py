"""Run the streaming job with the settings of the environment."""

import logging
import signal

from pyspark.sql.streaming import StreamingQuery

from tidings.config import JobConfig
from tidings.session import CONNECTORS, session
from tidings.sinks.console import tap
from tidings.sinks.files import parquet_letters
from tidings.sinks.jdbc import append, append_once
from tidings.sinks.kafka import topic_messages
from tidings.sources import Favourites, campaign_stream
from tidings.streaming import NotificationJob, ProgressLog
from tidings.streaming.drain import on_signal, run_until


def main() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    cfg = JobConfig.from_env()
    spark = session(cfg.name, packages=CONNECTORS)
    job = NotificationJob(
        favourites=Favourites(spark, cfg.favourites),
        table=append_once(cfg.feedback) if cfg.once else append(cfg.feedback),
        messages=topic_messages(cfg.messages),
        letters=parquet_letters(cfg.dead_letters),
        name=cfg.name,
    )
    asked = on_signal(signal.SIGTERM)
    progress = ProgressLog(job.sent)
    spark.streams.addListener(progress)
    messages = campaign_stream(spark, cfg.campaigns)
    queries = []
    try:
        if cfg.tap:
            queries.append(tap(messages, f"{cfg.checkpoint}/tap"))
        checkpoint = f"{cfg.checkpoint}/notifications"

        def start(trigger: dict | None) -> StreamingQuery:
            queries.append(job.start(messages, checkpoint, trigger))
            return queries[-1]

        run_until(spark, asked, start(cfg.trigger()), checkpoint, start)
    finally:
        for query in queries:
            query.stop()
        spark.streams.removeListener(progress)


if __name__ == "__main__":
    main()
