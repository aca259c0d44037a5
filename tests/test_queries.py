"""Every registered query against SQL over the same tables."""

import os

import __spark_entry__ as registry
import duckdb
import pytest
from pyspark.sql import functions as F
from samples import SF_DIR, Listed, bag

from tidings.sources import star_schema

TABLES = ["events", "lineitem", "orders"]
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string"}


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    """Tables of several files; one restaurant has a third of all, and many copies."""
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not here")
    folder = str(tmp_path_factory.mktemp("skewed"))
    event, line = F.col("event_id"), F.col("l_linenumber")
    skewed = {
        "events": {"user_id": F.when(event % 3 == 0, 1).otherwise(F.col("user_id"))},
        "lineitem": {
            "l_suppkey": F.when(line <= 2, 1).otherwise(F.col("l_suppkey")),
            "l_orderkey": F.when(line == 1, 0).otherwise(F.col("l_orderkey")),
        },
        "orders": {},
    }
    for name, columns in skewed.items():
        rows = star_schema.table(spark, SF_DIR, name).withColumns(columns)
        rows.repartition(4).write.parquet(f"{folder}/{name}.parquet")
    return folder


def check(spark, folder, files, name):
    with duckdb.connect() as database:
        for table in TABLES:
            database.sql(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet{files}'")
        relation = database.sql(registry.oracle_sql()[name])
        columns = sorted(relation.columns)
        expected = relation.select(*columns)
        types = [TYPES[str(kind)] for kind in expected.types]
        rows = expected.fetchall()
    found = registry.queries()[name](spark, folder)
    assert sorted(found.columns) == columns
    assert [dict(found.dtypes)[column] for column in columns] == types
    assert rows
    assert bag(found.select(*columns)) == bag(Listed(rows))


def test_every_query_has_sql():
    assert registry.notification_queries().keys() == registry.notification_sql().keys()


@pytest.mark.parametrize("name", registry.notification_queries())
def test_query_equals_sql(spark, sf_dir, name):
    check(spark, sf_dir, "", name)


@pytest.mark.parametrize("name", registry.notification_queries())
def test_query_equals_sql_on_skewed_tables(spark, skewed_dir, name):
    check(spark, skewed_dir, "/*.parquet", name)


def test_entry(spark, sf_dir):
    assert registry.entry(spark).count() == 1294
