"""The streaming job: same result as the batch, freshness, faults, replay."""

import logging
import os
import signal
import threading
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame
from samples import bag, messages, payload, plan_of

from tidings.operators import to_messages, to_notifications, with_feedback
from tidings.plans import Limits, notify
from tidings.sinks import files
from tidings.sinks.console import tap
from tidings.sources import file_campaign_stream, star_schema
from tidings.streaming import BatchCounts, NotificationJob, ProgressLog
from tidings.streaming.drain import on_signal, run_until, uncommitted
from __spark_entry__ import NOW

ONCE = {"availableNow": True}


class Bench:
    """A job between folders: messages in, rows, messages and letters out."""

    def __init__(self, spark, folder, name, now=50, limits=Limits()):
        self.spark, self.folder = spark, folder
        self.sinks = {
            "table": files.parquet_table(f"{folder}/table"),
            "messages": files.text_messages(f"{folder}/messages"),
            "letters": files.parquet_letters(f"{folder}/letters"),
        }
        self.name, self.now, self.limits = name, now, limits
        self.job = None

    def like(self, *pairs):
        rows = self.spark.createDataFrame(pairs, "client_id string, restaurant_id string")
        rows.write.mode("append").parquet(f"{self.folder}/favourites")

    def publish(self, *payloads, files=1):
        rows = messages(self.spark, payloads).select("key", "value")
        rows.repartition(files).write.mode("append").parquet(f"{self.folder}/in")

    def favourites(self):
        return self.spark.read.parquet(f"{self.folder}/favourites")

    def run(self, files_per_trigger=None):
        self.job = NotificationJob(
            favourites=lambda: self.favourites(),
            name=self.name,
            now=self.now,
            limits=self.limits,
            **self.sinks,
        )
        stream = file_campaign_stream(self.spark, f"{self.folder}/in", files_per_trigger)
        query = self.job.start(stream, f"{self.folder}/checkpoint", ONCE)
        try:
            query.awaitTermination()
        finally:
            query.stop()
        return query

    def rows(self):
        return files.read_table(self.spark, f"{self.folder}/table")

    def sent(self):
        return files.read_messages(self.spark, f"{self.folder}/messages")


@pytest.fixture
def bench(spark, folder, query_name):
    return Bench(spark, folder, query_name)


@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_bytes=0)])
def test_stream_equals_batch(spark, folder, query_name, sf_dir, limits):
    events = star_schema.table(spark, sf_dir, "events")
    favourites = star_schema.favourites(spark, sf_dir)
    bench = Bench(spark, folder, query_name, NOW, limits)
    favourites.write.parquet(f"{folder}/favourites")
    star_schema.messages(events).select("key", "value").repartition(5).write.parquet(f"{folder}/in")
    query = bench.run(files_per_trigger=1)
    assert query.lastProgress.batchId == 4
    expected = notify(star_schema.campaigns(events), favourites, NOW).drop("message_id")
    assert expected.count() == 1294
    assert bag(bench.rows().drop("feedback")) == bag(expected)
    assert bag(bench.sent()) == bag(to_messages(with_feedback(expected)))
    assert bench.rows().filter("feedback IS NOT NULL").isEmpty()


def test_same_campaign_twice_fans_out_twice(bench):
    bench.like(("a", "r1"), ("a", "r1"), ("b", "r1"), ("c", "r2"))
    bench.publish(payload(), payload())
    bench.run()
    assert sorted(row.client_id for row in bench.rows().collect()) == ["a", "a", "b", "b"]


def test_new_favourite_is_seen_by_the_next_batch(bench):
    bench.like(("a", "r1"))
    bench.publish(payload(campaign="one"))
    bench.run()
    bench.like(("b", "r1"))
    bench.publish(payload(campaign="two"))
    bench.run()
    found = {(r.adv_campaign_id, r.client_id) for r in bench.rows().collect()}
    assert found == {("one", "a"), ("two", "a"), ("two", "b")}


def test_new_favourite_is_seen_while_the_query_runs(bench):
    bench.like(("a", "r1"))
    bench.publish(payload(campaign="one"), payload(campaign="two"), files=2)
    write = bench.sinks["messages"]

    def write_and_like(df, batch):
        write(df, batch)
        if batch.batch_id == 0:
            bench.like(("b", "r1"))

    bench.sinks["messages"] = write_and_like
    bench.run(files_per_trigger=1)
    assert bench.job.sent == {0: 1, 1: 2}
    assert sorted(r.client_id for r in bench.rows().collect()) == ["a", "a", "b"]


def test_favourites_are_read_once_per_batch_and_the_batch_let_go(bench, monkeypatch):
    """Both sinks get one result, and a failure leaves nothing persisted."""
    held = []
    for name, step in (("persist", 1), ("unpersist", -1)):
        original = getattr(DataFrame, name)

        def counted(self, *args, _original=original, _step=step):
            held.append(_step)
            return _original(self, *args)

        monkeypatch.setattr(DataFrame, name, counted)
    reads = []
    favourites = bench.favourites
    bench.favourites = lambda: reads.append(1) or favourites()
    bench.like(("a", "r1"))
    bench.publish(payload(campaign="one"))
    bench.run()
    assert (reads, held) == ([1], [1, -1])
    bench.sinks["messages"], _ = failing(bench.sinks["messages"], "before")
    bench.publish(payload(campaign="two"))
    with pytest.raises(StreamingQueryException):
        bench.run()
    assert held == [1, -1] * 2


def test_clock_is_the_batch_time(bench):
    bench.now = None
    now = bench.spark.range(1).select(F.unix_timestamp().alias("t")).first().t
    bench.like(("a", "r1"))
    bench.publish(
        payload(campaign="runs", start=now - 5, end=now + 600),
        payload(campaign="over", start=now - 5, end=now - 1),
        payload(campaign="to come", start=now + 600, end=now + 900),
    )
    bench.run()
    (row,) = bench.rows().collect()
    assert row.adv_campaign_id == "runs"
    assert now <= row.trigger_datetime_created <= now + 60


def test_dead_letters_stay_out_of_the_sinks(bench):
    bench.like(("a", "r1"))
    bad = [payload(adv_campaign_owner=...), "no json", "", payload(start="1")]
    bench.publish(payload(), *bad, payload(end=40))
    bench.run()
    assert bench.rows().count() == 1
    letters = files.read_letters(bench.spark, f"{bench.folder}/letters")
    assert {r.payload for r in letters.collect()} == set(bad)


def test_stream_without_message_ids_is_refused(bench, spark):
    bench.publish(payload())
    job = NotificationJob(bench.favourites, **bench.sinks, name=bench.name)
    stream = file_campaign_stream(spark, f"{bench.folder}/in").drop("message_id")
    with pytest.raises(ValueError, match="message_id"):
        job.start(stream, f"{bench.folder}/checkpoint")


def test_no_active_campaign_writes_nothing(bench):
    bench.like(("a", "r1"))
    bench.publish(payload(end=40))
    bench.run()
    assert bench.job.sent == {0: 0}


class Fault(Exception):
    pass


def failing(sink, when):
    """``sink`` that fails once, before or after it wrote."""
    state = {"left": 1, "batches": []}

    def write(df, batch):
        state["batches"].append(batch)
        if when == "before" and state["left"]:
            state["left"] -= 1
            raise Fault(when)
        sink(df, batch)
        if when == "after" and state["left"]:
            state["left"] -= 1
            raise Fault(when)

    return write, state


@pytest.mark.parametrize("sink", ["table", "messages"])
@pytest.mark.parametrize("when", ["before", "after"])
def test_fault_in_a_sink_repeats_the_batch(bench, sink, when, caplog):
    bench.sinks[sink], state = failing(bench.sinks[sink], when)
    bench.like(("a", "r1"))
    bench.publish(payload())
    with caplog.at_level(logging.ERROR), pytest.raises(StreamingQueryException):
        bench.run()
    what = {"table": "notification rows", "messages": "notification messages"}[sink]
    assert f"batch 0: writing {what} failed" in caplog.text
    # A favourite that came meanwhile is not in the repeated batch: the rows and
    # messages stay those of its first attempt.
    bench.like(("b", "r1"))
    bench.run()
    first, second = state["batches"]
    assert first == second and first.batch_id == 0
    assert [r.client_id for r in bench.rows().collect()] == ["a"]
    assert bench.sent().count() == 1
    bench.publish(payload(campaign="two"))
    bench.run()
    assert bench.rows().count() == 3 and bench.sent().count() == 3


def test_repeated_batch_keeps_its_clock(bench):
    bench.now = None
    begin = int(time.time())
    bench.publish(payload(start=begin - 9, end=begin + 900))
    with pytest.raises(StreamingQueryException):
        bench.run()  # there are no favourites to read
    failed = time.time()
    time.sleep(2)
    bench.like(("a", "r1"))
    bench.run()
    (row,) = bench.rows().collect()
    assert begin <= row.trigger_datetime_created <= failed


def test_main(bench, spark, monkeypatch):
    """The settings come together; Kafka and the database are replaced by folders."""
    import tidings.__main__ as program

    now = int(time.time())
    bench.like(("a", "r1"))
    bench.publish(payload(start=now - 9, end=now + 900), "no json")
    env = {
        "KAFKA_SERVERS": "broker:9091",
        "TOPIC_IN": "in",
        "TOPIC_OUT": "out",
        "FAVOURITES_URL": "jdbc:x",
        "FEEDBACK_URL": "jdbc:x",
        "CHECKPOINT": f"{bench.folder}/checkpoint",
        "DEAD_LETTERS": f"{bench.folder}/letters",
        "BACKFILL": "1",
        "TAP": "1",
    }
    for name, value in env.items():
        monkeypatch.setenv(f"TIDINGS_{name}", value)
    replaced = {
        "session": lambda name, packages: spark,
        "campaign_stream": lambda spark, cfg: file_campaign_stream(spark, f"{bench.folder}/in"),
        "Favourites": lambda spark, cfg: lambda: spark.read.parquet(f"{bench.folder}/favourites"),
        "append_once": lambda cfg: bench.sinks["table"],
        "topic_messages": lambda cfg: bench.sinks["messages"],
    }
    for name, stand_in in replaced.items():
        monkeypatch.setattr(program, name, stand_in)
    program.main()
    assert bench.rows().count() == 1 and bench.sent().count() == 1
    assert files.read_letters(spark, f"{bench.folder}/letters").count() == 1
    assert not spark.streams.active


@pytest.mark.parametrize("sink", ["letters", "table"])
def test_lost_cache_changes_nothing(bench, spark, sink):
    """As after the loss of executors: what was cached is gone in mid-batch."""
    bench.like(("a", "r1"))
    bench.publish(payload(), payload(campaign="two"), "no json", files=2)
    write = bench.sinks[sink]

    def write_and_lose(df, batch):
        write(df, batch)
        spark.catalog.clearCache()
        if sink == "table":
            bench.like(("b", "r1"))

    bench.sinks[sink] = write_and_lose
    bench.run()
    assert bag(bench.sent()) == bag(to_messages(bench.rows()))
    assert [r.client_id for r in bench.rows().collect()] == ["a", "a"]


def test_restart_goes_on_where_it_stopped(bench):
    bench.like(("a", "r1"))
    bench.publish(payload(campaign="one"))
    first = bench.run()
    bench.publish(payload(campaign="two"))
    second = bench.run()
    assert first.id == second.id
    assert second.lastProgress.batchId == 1
    assert {r.adv_campaign_id for r in bench.rows().collect()} == {"one", "two"}
    assert bench.rows().count() == 2


def test_new_checkpoint_does_not_replace_old_rows(bench, spark):
    bench.like(("a", "r1"))
    bench.publish(payload())
    bench.run()
    job = bench.job
    stream = file_campaign_stream(spark, f"{bench.folder}/in")
    job.start(stream, f"{bench.folder}/other", ONCE).awaitTermination()
    assert bench.rows().count() == 2


def test_stream_joins_a_table_directly(spark, folder, query_name, sf_dir):
    """The operators alone, without the job: a streaming DataFrame in and out."""
    from tidings.operators import active_at, decode_campaigns, dedupe_favourites, fan_out, stamp

    events = star_schema.table(spark, sf_dir, "events")
    star_schema.messages(events).select("key", "value").write.parquet(f"{folder}/in")
    favourites = star_schema.favourites(spark, sf_dir)
    campaigns = active_at(decode_campaigns(file_campaign_stream(spark, f"{folder}/in")), NOW)
    found = to_notifications(fan_out(stamp(campaigns, NOW), dedupe_favourites(favourites)))
    assert found.isStreaming
    query = (
        found.writeStream.format("parquet")
        .queryName(query_name)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**ONCE)
        .start(f"{folder}/out")
    )
    query.awaitTermination()
    expected = notify(star_schema.campaigns(events), favourites, NOW)
    assert bag(spark.read.parquet(f"{folder}/out").drop("message_id")) == bag(
        expected.drop("message_id")
    )


def test_tap_is_a_query_of_its_own(bench, spark, capsys):
    bench.publish(payload(restaurant="tapped"), payload(restaurant="tapped"))
    query = tap(
        file_campaign_stream(spark, f"{bench.folder}/in"), f"{bench.folder}/tap", bench.name, rows=1
    )
    try:
        assert query.isActive
        query.processAllAvailable()
        assert capsys.readouterr().out.count("tapped") == 1
    finally:
        query.stop()


def test_progress_log(bench, spark, caplog):
    bench.like(("a", "r1"), ("b", "r1"))
    bench.publish(payload(), "no json", payload(end=40))
    with caplog.at_level(logging.INFO, logger="tidings"):
        job_sent = BatchCounts()
        listener, other = ProgressLog(job_sent), ProgressLog(job_sent)
        spark.streams.addListener(listener)
        spark.streams.addListener(other)
        try:
            job = NotificationJob(
                favourites=lambda: spark.read.parquet(f"{bench.folder}/favourites"),
                name=bench.name,
                now=50,
                sent=job_sent,
                **bench.sinks,
            )
            stream = file_campaign_stream(spark, f"{bench.folder}/in")
            job.start(stream, f"{bench.folder}/checkpoint", ONCE).awaitTermination()
            for _ in range(100):  # the listener hears of it a little later
                if caplog.text.count("rows in") == 2:
                    break
                time.sleep(0.1)
        finally:
            spark.streams.removeListener(listener)
            spark.streams.removeListener(other)
    logged = [record.getMessage() for record in caplog.records]
    line, same = [text for text in logged if "batch 0:" in text and "rows in" in text]
    assert line == same
    assert "3 rows in" in line and "2 notifications out" in line
    assert "'messages': 3, 'incomplete': 1, 'active': 1" in line


class Killed(files.FileSink):
    """Dies between the rows and the commit, some times."""

    def __init__(self, sink, times=1):
        super().__init__(sink.path, sink.form, sink.columns)
        self.times = times

    def commit(self, spark, batch, attempt):
        if self.times:
            self.times -= 1
            raise Fault("killed")
        super().commit(spark, batch, attempt)


def test_readers_never_see_a_batch_that_was_not_committed(bench, spark):
    """Each sink in turn dies between its rows and their commit."""
    read = {"letters": lambda: files.read_letters(spark, f"{bench.folder}/letters"), "table": bench.rows, "messages": bench.sent}
    bench.like(("a", "r1"), ("b", "r1"))
    bench.publish(payload(campaign="one"), "no json")
    bench.run()
    before = {name: bag(read[name]()) for name in read}
    bench.publish(payload(campaign="two"), "{}")
    for name in read:
        bench.sinks[name] = Killed(bench.sinks[name])
        with pytest.raises(StreamingQueryException):
            bench.run()
        assert bag(read[name]()) == before[name]  # the batch before is whole, the new one isn't shown
    assert files.leftovers(spark, f"{bench.folder}/table").count() == 1
    assert files.leftovers(spark, f"{bench.folder}/letters").count() == 1
    bench.run()
    assert bag(bench.rows().select("adv_campaign_id", "client_id")) == {(c, u): 1 for c in ("one", "two") for u in "ab"}
    assert bag(bench.sent()) == bag(to_messages(bench.rows()))
    assert read["letters"]().count() == 2


def test_half_written_attempts_are_not_read(bench, spark):
    """Not even while a repeat of the batch is under way: the rows that are shown stay."""
    bench.like(("a", "r1"))
    bench.publish(payload(campaign="one"))
    bench.run()
    (place,) = spark.read.schema(files.PLACE).parquet(f"{bench.folder}/table/data").collect()
    batch = files.Batch(place.query_id, place.batch_id)
    sink = bench.sinks["table"]
    bad = bench.rows().withColumn("client_id", F.lit("half"))
    sink.draft(bad, batch)
    assert [r.client_id for r in bench.rows().collect()] == ["a"]
    sink(bad, batch)  # committed before: left alone
    assert [r.client_id for r in bench.rows().collect()] == ["a"]
    sink.commit(spark, batch, sink.draft(bad, batch))  # another driver's late commit
    assert [r.client_id for r in bench.rows().collect()] == ["a"]
    sink.commit(spark, files.Batch(place.query_id, 1), sink.draft(bad, files.Batch(place.query_id, 1)))
    assert sorted(r.client_id for r in bench.rows().collect()) == ["a", "half"]


def test_only_committed_folders_are_scanned(bench, spark):
    bench.like(("a", "r1"))
    for name in ("one", "two", "three"):
        bench.publish(payload(campaign=name))
        bench.run()
    bench.sinks["table"].draft(bench.rows(), files.Batch("left-over", 0))
    assert "dynamicpruning" in plan_of(bench.rows()).lower()
    assert bench.rows().count() == 3


def test_nothing_is_read_before_the_first_commit(spark, folder):
    assert files.read_table(spark, f"{folder}/table").collect() == []
    assert files.read_messages(spark, f"{folder}/messages").columns == ["value"]
    assert files.leftovers(spark, f"{folder}/table").collect() == []


def test_messages_of_a_repeated_batch_have_the_same_headers(bench):
    """By a stand-in for the topic, which takes what it gets, repeats as well."""
    topic = []

    def send(df, batch):
        topic.append(sorted((row.value, tuple((h.key, bytes(h.value).decode()) for h in row.headers)) for row in df.collect()))
        if len(topic) == 1:
            raise Fault("the broker took them, the answer was lost")

    bench.sinks["messages"] = send
    bench.like(("a", "r1"), ("b", "r1"))
    bench.publish(payload(), payload())
    with pytest.raises(StreamingQueryException):
        bench.run()
    bench.run()
    assert topic[0] == topic[1] and len(topic[0]) == 4
    assert len({headers for _, headers in topic[0]}) == 4  # equal texts are told apart
    assert {headers[1] for _, headers in topic[0]} == {("client_id", "a"), ("client_id", "b")}
    assert {headers[0][0] for _, headers in topic[0]} == {"message_id"}


def test_counts_are_bounded_and_stay():
    counts = BatchCounts(keep=3)
    for batch in range(10):
        counts[batch] = batch * batch
        counts[batch] = batch
    assert counts == {7: 7, 8: 8, 9: 9}
    assert [counts.get(8), counts.get(8), counts.get(2)] == [8, 8, None]


def test_signalled_job_leaves_no_batch_half_way(bench, spark):
    """Signalled while a batch runs and more are waiting."""
    bench.like(("a", "r1"))
    for at in range(6):
        bench.publish(payload(campaign=f"c{at}"))
    write = bench.sinks["table"]
    before = signal.getsignal(signal.SIGTERM)
    asked = on_signal(signal.SIGTERM)

    def slow(df, batch):
        write(df, batch)
        if batch.batch_id == 1:
            os.kill(os.getpid(), signal.SIGTERM)
            time.sleep(2)

    bench.sinks["table"] = slow
    checkpoint = f"{bench.folder}/checkpoint"
    job = NotificationJob(favourites=bench.favourites, name=bench.name, now=50, **bench.sinks)
    stream = file_campaign_stream(spark, f"{bench.folder}/in", 1)
    try:
        query = job.start(stream, checkpoint)
        run_until(spark, asked, query, checkpoint, lambda trigger: job.start(stream, checkpoint, trigger))
    finally:
        signal.signal(signal.SIGTERM, before)
    assert asked.is_set() and not spark.streams.active
    assert not uncommitted(spark, checkpoint)
    done = bench.rows().count()
    assert 2 <= done <= 6 and bench.sent().count() == done
    bench.run()
    assert bench.rows().count() == 6 and bench.sent().count() == 6


def test_batch_that_had_begun_is_finished(bench, spark):
    """As when a stop comes too late: the batch's offsets are there, its commit isn't."""
    bench.like(("a", "r1"))
    bench.publish(payload())
    bench.sinks["messages"], _ = failing(bench.sinks["messages"], "before")
    with pytest.raises(StreamingQueryException):
        bench.run()
    checkpoint = f"{bench.folder}/checkpoint"
    assert uncommitted(spark, checkpoint)
    asked = threading.Event()
    asked.set()

    class Stopped:
        isActive = False

        def stop(self):
            pass

    stream = file_campaign_stream(spark, f"{bench.folder}/in", 1)
    job = NotificationJob(favourites=bench.favourites, name=bench.name, now=50, **bench.sinks)
    run_until(spark, asked, Stopped(), checkpoint, lambda trigger: job.start(stream, checkpoint, trigger))
    assert not uncommitted(spark, checkpoint)
    assert bench.sent().count() == 1
