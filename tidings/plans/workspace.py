"""Tables that hold an intermediate result in the cluster's shared folder.

Executors may be lost at any time. What was written here is read back instead
of being computed again, and it is the same for everyone who reads it.
"""

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHECKPOINT_DIR = "spark.checkpoint.dir"


@cache
def _local_folder(application_id: str) -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="tidings-")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local master may go without: its executors share the driver's disk.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if spark.conf.get("spark.master", "").startswith("local"):
        return _local_folder(spark.sparkContext.applicationId).name
    raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors can reach")


class Workspace:
    """A folder for one run's held tables.

    Without a name the folder is fresh. With one, ``hold`` replaces the table of
    the same name, so a long-running job keeps a fixed number of tables.
    """

    def __init__(self, spark: SparkSession, name: str | None = None):
        self._spark = spark
        self._held: set[str] = set()
        self.path = f"{shared_folder(spark)}/tidings/{name or uuid.uuid4().hex}"

    def hold(self, df: DataFrame, table: str) -> DataFrame:
        """Write ``df`` once and return the written table."""
        df.write.mode("overwrite").parquet(f"{self.path}/{table}")
        self._held.add(table)
        return self.read(table, df.schema)

    def ensure(self, df: DataFrame, table: str) -> None:
        """Write ``df`` unless the table is there."""
        df.write.mode("ignore").parquet(f"{self.path}/{table}")

    def read(self, table: str, schema: StructType | str | None = None) -> DataFrame:
        """A held table; with no schema given, the one it was written with."""
        reader = self._spark.read.schema(schema) if schema else self._spark.read
        return reader.parquet(f"{self.path}/{table}")

    def clear(self) -> None:
        """Give the room back: nothing that was read from here can be used after."""
        for table in sorted(self._held):
            self._spark.range(0).write.mode("overwrite").parquet(f"{self.path}/{table}")
        self._held.clear()
