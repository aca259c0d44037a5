"""Settings and options of the connectors. No broker or database is contacted."""

import sys

import duckdb
import pandas
import pyspark
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import GOLDEN
from tidings import config, session
from tidings.config import JdbcConfig, JobConfig, KafkaConfig
from tidings.functions.ids import topic_message_id
from tidings.operators import with_feedback
from tidings.schemas import CAMPAIGN_SCHEMA, FEEDBACK_COLUMNS, NOTIFICATION_COLUMNS
from tidings.sinks import Batch, jdbc, kafka
from tidings.sources import campaigns, ranges, tables

TOPIC = KafkaConfig("broker:9091", "campaigns", "user", 'pa"ss\\word')
TABLE = JdbcConfig("jdbc:postgresql://host/db", "public.favourites", "user", "secret")
BATCH = Batch("6f1f3a86-5a39-4c1c-9a3f-0b6d5a1c2e3f", 7)


class Recorder:
    """Stands in for a reader, writer or connection: notes every call."""

    def __init__(self, calls=None, results=()):
        self.calls, self.results = [] if calls is None else calls, dict(results)

    def __getattr__(self, name):
        def call(*args, **kwargs):
            self.calls.append((name, args, kwargs))
            return self.results.get(name, self)

        return call

    def given(self):
        """The options of all calls together."""
        options = {}
        for name, _, kwargs in self.calls:
            if name == "options":
                options |= kwargs
        return options


def test_kafka_connection():
    options = TOPIC.connection()
    assert options["kafka.bootstrap.servers"] == "broker:9091"
    assert options["kafka.security.protocol"] == "SASL_SSL"
    assert options["kafka.sasl.mechanism"] == "SCRAM-SHA-512"
    assert options["kafka.sasl.jaas.config"].endswith(
        'ScramLoginModule required username="user" password="pa\\"ss\\\\word";'
    )
    assert KafkaConfig("broker:9091", "t").connection() == {
        "kafka.bootstrap.servers": "broker:9091"
    }


def test_topic_options():
    options = campaigns.topic_options(TOPIC)
    assert options["subscribe"] == "campaigns" and options["startingOffsets"] == "latest"
    assert "maxOffsetsPerTrigger" not in options
    limited = KafkaConfig("b", "t", max_offsets_per_trigger=9, max_records_per_partition=3)
    options = campaigns.topic_options(limited)
    assert (options["maxOffsetsPerTrigger"], options["maxRecordsPerPartition"]) == ("9", "3")


def test_topic_stream(spark):
    session = type("Session", (), {})()
    session.readStream = reader = Recorder()
    campaigns.campaign_stream(session, TOPIC)
    assert ("format", ("kafka",), {}) in reader.calls
    assert reader.given() == campaigns.topic_options(TOPIC)
    name, columns, _ = reader.calls[-1]
    assert name == "select" and columns[:2] == ("key", "value")
    assert "message_id" in str(columns[2])


def test_topic_message_id(spark):
    rows = spark.createDataFrame([("t", 3, 42)], "topic string, partition int, offset long")
    assert rows.select(topic_message_id()).first()[0] == "t:3:42"


def test_messages_to_topic(spark):
    calls = []

    class Messages:
        def select(self, *columns):
            calls.append(("select", columns, {}))
            return self

        columns = ["value"]
        write = Recorder(calls)

    kafka.topic_messages(TOPIC)(Messages(), BATCH)
    assert ("select", ("value",), {}) in calls  # no key
    with_headers = type("WithHeaders", (Messages,), {"columns": ["value", "headers"]})
    kafka.topic_messages(TOPIC)(with_headers(), BATCH)
    assert ("select", ("value", "headers"), {}) in calls
    assert ("format", ("kafka",), {}) in calls
    assert ("option", ("topic", "campaigns"), {}) in calls
    assert calls[-1][0] == "save"


def test_jdbc_read_options():
    options = tables.read_options(TABLE)
    assert options["fetchsize"] == "10000" and options["url"] == TABLE.url
    assert options["user"] == "user" and options["password"] == "secret"


class Database:
    """Stands in for the reader: answers the questions about ids from a list of them."""

    def __init__(self, ids):
        self.ids, self.asked, self.read = ids, [], None

    def format(self, name):
        assert name == "jdbc"
        return self

    def options(self, query, **connection):
        assert connection == TABLE.connection()
        self.asked.append(query)
        return self

    def load(self):
        return self

    def collect(self):
        view = pandas.DataFrame({"id": pandas.Series(self.ids, dtype="Int64")})
        with duckdb.connect() as database:
            database.register("favourites_view", view)
            return database.sql(self.asked[-1].replace("public.favourites", "favourites_view")).fetchall()

    def jdbc(self, url, table, predicates, properties):
        self.read = (url, table, predicates, properties)
        return self


def rows_of(ids, conditions):
    """Rows that meet each condition."""
    view = pandas.DataFrame({"id": pandas.Series(ids, dtype="Int64")})
    with duckdb.connect() as database:
        database.register("ids", view)
        return [database.sql(f"SELECT count(*) FROM ids WHERE {one}").fetchall()[0][0] for one in conditions]


def reading(ids):
    session = type("Session", (), {})()
    session.read = Database(ids)
    return session


SKEWED = {
    "dense": list(range(1, 5001)),
    "one far id": [*range(1, 4000), 2**31 - 1],
    "two far heaps": [*range(3000), *range(10**12, 10**12 + 3000)],
    "negative and null": [*range(-2000, 0), None, None, *range(10**9, 10**9 + 50)],
    "squares": [at * at for at in range(3000)],
    "most rows in one id": [7] * 3000 + list(range(100, 1100)),
}


@pytest.mark.parametrize("name", SKEWED)
def test_favourites_are_read_in_equal_ranges(name):
    """Every row is in one range, and none has much more than its share but for a single id."""
    ids = SKEWED[name]
    session = reading(ids)
    tables.favourites(session, TABLE)
    url, table, predicates, properties = session.read.read
    assert (url, table) == (TABLE.url, "public.favourites") and properties["fetchsize"] == "10000"
    found = rows_of(ids, predicates)
    assert sum(found) == len(ids) and sum(rows_of(ids, [f"({one})" for one in predicates])) == len(ids)
    assert len(predicates) <= TABLE.partitions
    share = len(ids) / TABLE.partitions
    if name != "most rows in one id":
        assert len(predicates) == TABLE.partitions
        assert max(found) <= 1.6 * share
    assert len(session.read.asked) < 40
    later = rows_of([None, -(10**15), 10**15], predicates)  # rows that come after the count
    assert sum(later) == 3


@pytest.mark.parametrize("ids", [[], [5], [5, 5, 5], [None, None], [None, 3]])
def test_favourites_without_ranges(ids):
    session = reading(ids)
    tables.favourites(session, TABLE)
    assert session.read.read[2] == ["1 = 1"]
    assert rows_of(ids, session.read.read[2]) == [len(ids)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(10**6), 10**6), unique=True, min_size=1, max_size=300), st.integers(2, 12))
def test_ranges_part_any_ids(ids, parts):
    def count(low, high, width):
        bins = {}
        for one in ids:
            if low <= one <= high:
                bins.setdefault((one - low) // width, []).append(one)
        return [ranges.Bin(min(some), max(some), len(some)) for some in bins.values()]

    conditions = ranges.ranges((min(ids), max(ids)), count, parts, "id")
    assert len(conditions) <= parts

    def meets(condition, id):
        return eval(condition.replace(" OR id IS NULL", "").replace("AND", "and").replace(" = ", " == "), {"id": id})

    assert all(sum(bool(meets(one, id)) for one in conditions) == 1 for id in ids)


def test_ranges_are_kept_for_some_batches():
    session = reading(list(range(100)))
    source = tables.Favourites(session, TABLE, refresh=3)
    asked = []
    for _ in range(4):
        source()
        asked.append(len(session.read.asked))
    assert asked[0] == asked[1] == asked[2] < asked[3]


def notifications(spark):
    schema = CAMPAIGN_SCHEMA.simpleString()[7:-1].replace(":", " ")
    rows = [("m0", *row) for row in GOLDEN]
    found = spark.createDataFrame(
        rows, f"message_id string, {schema}, client_id string, trigger_datetime_created int"
    )
    return with_feedback(found)


class Frame:
    """A DataFrame whose writer is a recorder."""

    def __init__(self, df, writer):
        self.df, self.write = df, writer

    def select(self, *columns):
        return Frame(self.df.select(*columns), _Named(self.write, self.df.select(*columns)))

    def distinct(self):
        return Frame(self.df.distinct(), self.write)

    def count(self):
        return self.df.count()


class _Named:
    def __init__(self, writer, df):
        self._writer, self._df = writer, df

    def format(self, source):
        self._writer.calls.append(("columns", tuple(self._df.columns), {}))
        return self._writer.format(source)


def test_jdbc_append(spark):
    writer = Recorder()
    jdbc.append(TABLE)(Frame(notifications(spark), writer), BATCH)
    names = [name for name, _, _ in writer.calls]
    assert names == ["columns", "format", "mode", "options", "save"]
    assert writer.calls[0][1] == tuple(FEEDBACK_COLUMNS)  # the database makes the id
    assert ("mode", ("append",), {}) in writer.calls
    assert writer.given()["numPartitions"] == "8"


class Connection(Recorder):
    """Answers the ledger's question, and fails where it is told to."""

    def __init__(self, recorded, fail_on=None, rowcount=-1):
        super().__init__()
        self.rowcount = rowcount
        self.recorded, self.fail_on = recorded, fail_on

    def cursor(self):
        return self

    def close(self):
        self.calls.append(("close", (), {}))

    def fetchone(self):
        return (1,) if self.recorded else None

    def execute(self, sql):
        self.calls.append(("execute", (sql,), {}))
        if self.fail_on and self.fail_on in sql:
            raise RuntimeError("lost connection")

    def done(self):
        """Calls in order, statements by their start."""
        return [
            args[0].split(" (")[0] if name == "execute" else name for name, args, _ in self.calls
        ]


def test_jdbc_once_stages_then_moves(spark):
    writer, connection = Recorder(), Connection(recorded=False)
    jdbc.append_once(TABLE, lambda: connection)(Frame(notifications(spark), writer), BATCH)
    assert writer.calls[0][1] == ("query_id", "batch_id", "message_id", *FEEDBACK_COLUMNS)
    assert ("mode", ("overwrite",), {}) in writer.calls
    assert writer.given()["dbtable"] == f"public.favourites_staging_{BATCH.query_id.replace('-', '')[:12]}"
    assert writer.given()["truncate"] == "true"
    inserts = [args[0] for name, args, _ in connection.calls if name == "execute"][-2:]
    assert inserts[0].startswith("INSERT INTO public.favourites_ledger ")
    assert inserts[1].startswith("INSERT INTO public.favourites (restaurant_id, ")
    assert "SELECT DISTINCT message_id, restaurant_id" in inserts[1]
    assert f"query_id = '{BATCH.query_id}' AND batch_id = 7" in inserts[1]
    after = connection.done()[connection.done().index("INSERT INTO public.favourites_ledger") :]
    assert after[2] == "commit" and "rollback" not in after


def test_jdbc_once_stages_apart_for_each_query(spark):
    names = set()
    for query_id in ("0" * 32, "1" * 32):
        writer = Recorder()
        batch = Batch(query_id, 7)
        jdbc.append_once(TABLE, lambda: Connection(recorded=False))(Frame(notifications(spark), writer), batch)
        names.add(writer.given()["dbtable"])
    assert len(names) == 2


def test_jdbc_once_leaves_a_recorded_batch_alone(spark):
    writer, connection = Recorder(), Connection(recorded=True)
    jdbc.append_once(TABLE, lambda: connection)(Frame(notifications(spark), writer), BATCH)
    assert not writer.calls
    assert not any("INSERT" in str(call) for call in connection.calls)


def test_jdbc_once_rolls_back(spark):
    connection = Connection(recorded=False, fail_on="INSERT INTO public.favourites (")
    with pytest.raises(RuntimeError, match="lost connection"):
        jdbc.append_once(TABLE, lambda: connection)(Frame(notifications(spark), Recorder()), BATCH)
    assert connection.done()[-3:] == ["rollback", "close", "close"]


def test_jdbc_once_counts_what_it_moves(spark):
    found = notifications(spark)
    whole = Connection(recorded=False, rowcount=found.count())
    jdbc.append_once(TABLE, lambda: whole)(Frame(found, Recorder()), BATCH)
    assert "rollback" not in whole.done()
    short = Connection(recorded=False, rowcount=0)
    with pytest.raises(RuntimeError, match="0 rows of batch 7"):
        jdbc.append_once(TABLE, lambda: short)(Frame(found, Recorder()), BATCH)
    assert short.done()[-3:] == ["rollback", "close", "close"]


def test_jdbc_once_needs_a_driver(monkeypatch):
    for name in ("psycopg2", "psycopg"):
        monkeypatch.setitem(sys.modules, name, None)
    with pytest.raises(ImportError, match="psycopg"):
        jdbc.append_once(TABLE)


ENV = {
    "TIDINGS_KAFKA_SERVERS": "broker:9091",
    "TIDINGS_KAFKA_USERNAME": "user",
    "TIDINGS_KAFKA_PASSWORD": "kafka secret",
    "TIDINGS_TOPIC_IN": "in",
    "TIDINGS_TOPIC_OUT": "out",
    "TIDINGS_MAX_OFFSETS_PER_TRIGGER": "1000",
    "TIDINGS_FAVOURITES_URL": "jdbc:postgresql://one/db",
    "TIDINGS_FEEDBACK_URL": "jdbc:postgresql://two/db",
    "TIDINGS_FEEDBACK_PASSWORD": "table secret",
    "TIDINGS_CHECKPOINT": "/shared/checkpoint",
    "TIDINGS_DEAD_LETTERS": "/shared/letters",
}


def test_backfill_takes_the_topic_from_its_start():
    assert JobConfig.from_env(ENV).campaigns.starting_offsets == "latest"
    backfill = ENV | {"TIDINGS_BACKFILL": "1"}
    assert JobConfig.from_env(backfill).campaigns.starting_offsets == "earliest"
    chosen = JobConfig.from_env(backfill | {"TIDINGS_STARTING_OFFSETS": "latest"})
    assert chosen.campaigns.starting_offsets == "latest"


def test_job_config():
    cfg = JobConfig.from_env(ENV)
    assert (cfg.campaigns.topic, cfg.messages.topic) == ("in", "out")
    assert cfg.campaigns.max_offsets_per_trigger == 1000
    assert cfg.favourites.table == "subscribers_restaurants"
    assert cfg.feedback.table == "subscribers_feedback"
    assert cfg.favourites.driver == config.JDBC_DRIVER
    assert cfg.once and not JobConfig.from_env(ENV | {"TIDINGS_ONCE": "0"}).once
    assert "secret" not in repr(cfg)
    with pytest.raises(KeyError, match="TIDINGS_CHECKPOINT"):
        JobConfig.from_env({k: v for k, v in ENV.items() if k != "TIDINGS_CHECKPOINT"})


def test_trigger():
    assert JobConfig.from_env(ENV).trigger() is None
    paced = JobConfig.from_env(ENV | {"TIDINGS_TRIGGER_SECONDS": "5"})
    assert paced.trigger() == {"processingTime": "5 seconds"}
    backfill = JobConfig.from_env(ENV | {"TIDINGS_BACKFILL": "1"})
    assert backfill.trigger() == {"availableNow": True}


def test_connectors_match_the_running_spark():
    assert f"spark-sql-kafka-0-10_2.13:{pyspark.__version__}" in session.CONNECTORS[0]


def test_session_is_in_utc(spark):
    assert session.session(conf={"spark.sql.session.timeZone": "Asia/Tokyo"}) is not None
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_columns():
    assert len(NOTIFICATION_COLUMNS) == 10 and len(FEEDBACK_COLUMNS) == 11
