"""Notification rows to a database table."""

import uuid
from collections.abc import Callable
from contextlib import closing
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.config import JdbcConfig
from tidings.schemas import FEEDBACK_COLUMNS, MESSAGE_ID
from tidings.sinks import Batch, Sink

Connect = Callable[[], Any]  # opens a DB-API 2.0 connection without autocommit


def write_options(cfg: JdbcConfig, table: str) -> dict[str, str]:
    """``numPartitions`` caps the connections that are open at once."""
    return {
        **cfg.connection(),
        "dbtable": table,
        "batchsize": str(cfg.batch_rows),
        "numPartitions": str(cfg.partitions),
    }


def append(cfg: JdbcConfig) -> Sink:
    """Append to the table; a repeated batch, or task, appends its rows again."""

    def write_feedback(feedback: DataFrame, batch: Batch) -> None:
        rows = feedback.select(*FEEDBACK_COLUMNS)
        rows.write.format("jdbc").mode("append").options(**write_options(cfg, cfg.table)).save()

    return write_feedback


def append_once(cfg: JdbcConfig, connect: Connect | None = None) -> Sink:
    """Append each notification exactly once.

    Executors fill a staging table. Then one transaction moves the batch to the
    table and enters it in a ledger; a batch found there is left alone. A task
    that ran twice staged its rows twice: they agree in the message id too, so
    DISTINCT leaves one, while equal rows of different messages all stay. Rows of
    other batches, from a task that outlived its query, are not selected. The batch's
    rows are counted before; if another number was moved, everything is rolled back.
    A connection that can't tell the number (``rowcount`` of -1) is trusted.
    """
    connect = connect or _postgres(cfg)
    ledger = f"{cfg.table}_ledger"

    def write_feedback(feedback: DataFrame, batch: Batch) -> None:
        this_batch = (
            f"query_id = '{uuid.UUID(batch.query_id)}' AND batch_id = {int(batch.batch_id)}"
        )
        # Of the query's own, so that another query's overwrite can't empty it.
        staging = f"{cfg.table}_staging_{uuid.UUID(batch.query_id).hex[:12]}"
        recorded = f"SELECT 1 FROM {ledger} WHERE {this_batch}"
        with closing(connect()) as connection, closing(connection.cursor()) as cursor:
            cursor.execute(
                f"CREATE TABLE IF NOT EXISTS {ledger} (query_id varchar(36) NOT NULL, "
                "batch_id bigint NOT NULL, PRIMARY KEY (query_id, batch_id))"
            )
            connection.commit()
            cursor.execute(recorded)
            if cursor.fetchone():
                return
        rows = feedback.select(
            F.lit(batch.query_id).alias("query_id"),
            F.lit(batch.batch_id).cast("long").alias("batch_id"),
            MESSAGE_ID,
            *FEEDBACK_COLUMNS,
        )
        (
            rows.write.format("jdbc")
            .mode("overwrite")
            .options(**write_options(cfg, staging), truncate="true")
            .save()
        )
        expected = rows.distinct().count()
        columns = ", ".join(FEEDBACK_COLUMNS)
        with closing(connect()) as connection, closing(connection.cursor()) as cursor:
            try:
                # The key makes a second writer of the same batch fail here.
                cursor.execute(
                    f"INSERT INTO {ledger} (query_id, batch_id) "
                    f"VALUES ('{uuid.UUID(batch.query_id)}', {int(batch.batch_id)})"
                )
                cursor.execute(
                    f"INSERT INTO {cfg.table} ({columns}) SELECT {columns} FROM "
                    f"(SELECT DISTINCT {MESSAGE_ID}, {columns} FROM {staging} "
                    f"WHERE {this_batch}) AS staged"
                )
                if cursor.rowcount not in (expected, -1):
                    raise RuntimeError(f"{cursor.rowcount} rows of batch {batch.batch_id} were staged, not {expected}")
                connection.commit()
            except BaseException:
                connection.rollback()
                raise

    return write_feedback


def _postgres(cfg: JdbcConfig) -> Connect:
    """Connect from the driver; a URL with options that only JDBC knows will not do."""
    try:
        import psycopg2 as postgres
    except ImportError:
        try:
            import psycopg as postgres
        except ImportError as err:
            raise ImportError(
                "append_once needs psycopg2 or psycopg on the driver, or a connect function"
            ) from err
    address = cfg.url.removeprefix("jdbc:")
    return lambda: postgres.connect(address, user=cfg.user, password=cfg.password)
