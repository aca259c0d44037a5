"""The Spark session."""

import os
from collections.abc import Mapping, Sequence
from pathlib import Path

import pyspark
from pyspark.sql import SparkSession

# Connectors, in the versions that fit the running Spark (built for Scala 2.13).
CONNECTORS = (
    f"org.apache.spark:spark-sql-kafka-0-10_2.13:{pyspark.__version__}",
    "org.postgresql:postgresql:42.7.4",
)


def session(
    name: str = "campaign_notifications",
    packages: Sequence[str] = (),
    conf: Mapping[str, str] | None = None,
) -> SparkSession:
    """Get or create a session whose time zone is UTC."""
    builder = SparkSession.builder.appName(name)
    if packages:
        builder = builder.config("spark.jars.packages", ",".join(packages))
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return in_utc(builder.getOrCreate())


def in_utc(spark: SparkSession) -> SparkSession:
    """Make a given session fit: all instants are epoch seconds in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    It helps where they see the driver's folders, like on a local master. Elsewhere
    install the package or hand it over with ``--py-files``; the path then does no harm.
    """
    folder = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if folder not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (folder, known)))
    return spark
