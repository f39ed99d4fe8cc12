"""Idempotent sinks.

A micro-batch owns the folder ``batch_id=N`` of its table and overwrites it as a whole, so
a batch that is run again after a failure replaces its own rows. A table that another stream
reads is written ``once``: a folder that is complete is left alone, so a batch that is run
again shows its reader no new files. Readers take the last (or
first) row per key over all batches; :func:`compact` folds a long log into a new table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from marketpulse.session import ROCKSDB, STATE_STORE
from marketpulse.sources.tables import current_rows

#: Spark's own choice, which has no keyed state (``streaming.keyed``).
_IN_MEMORY = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_STARTING = Lock()


def write_batch(
    df: DataFrame,
    path: str,
    batch_id: int,
    partition_by: tuple[str, ...] = (),
    once: bool = False,
) -> None:
    if once and _complete(df, f"{path}/batch_id={batch_id}"):
        return
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/batch_id={batch_id}")


def _complete(df: DataFrame, folder: str) -> bool:
    spark = df.sparkSession
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def batch_writer(
    path: str, partition_by: tuple[str, ...] = ()
) -> Callable[[DataFrame, int], None]:
    return lambda df, batch_id: write_batch(df, path, batch_id, partition_by)


def messages(df: DataFrame, key: str) -> DataFrame:
    """Rows as keyed JSON messages, the layout a Kafka topic takes."""
    return df.select(F.col(key).alias("key"), F.to_json(F.struct("*")).alias("value"))


def start_kafka(
    df: DataFrame, key: str, topic: str, servers: str, checkpoint: str
) -> StreamingQuery:
    """Publish rows to a topic keyed by ticker or card. Needs Spark's Kafka package."""
    writer = messages(df, key).writeStream.format("kafka")
    options = {"kafka.bootstrap.servers": servers, "topic": topic}
    with _job_settings(df.sparkSession):
        return writer.options(**options, checkpointLocation=checkpoint).start()


def compact(log: DataFrame, keys: list[str], target: str) -> None:
    """Write the current rows of a change log as batch 0 of a new one."""
    write_batch(current_rows(log, keys), target, 0)


def start(
    df: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    *,
    mode: str = "append",
    every: str | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Start a query; without ``every`` it works off what is there and stops."""
    writer = df.writeStream.foreachBatch(sink)
    if name:
        writer = writer.queryName(name)
    return launch(df.sparkSession, writer, checkpoint, mode=mode, every=every)


def launch(
    spark: SparkSession,
    writer: DataStreamWriter,
    checkpoint: str,
    *,
    mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Start a query whose sink is set; without ``every`` it works off what is there and stops."""
    writer = writer.outputMode(mode).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    with _job_settings(spark, mode):
        return writer.trigger(**trigger).start()


@contextmanager
def _job_settings(spark: SparkSession, mode: str = "append") -> Iterator[None]:
    """What a job needs of the session that starts it, which it copies; taken back after that.

    Keyed state lives in RocksDB, whatever session calls; another provider than Spark's own
    default is kept, and a checkpoint goes on with the one it began with. In update mode rows
    come from input only, so batches without any are left out: with a time to live Spark would
    run one at every trigger, and a job would never have worked off what is there.
    """
    with _STARTING:
        wanted = {}
        if spark.conf.get(STATE_STORE, None) in (None, _IN_MEMORY):
            wanted[STATE_STORE] = ROCKSDB
        if mode == "update":
            wanted[_EMPTY_BATCHES] = "false"
        before = {key: spark.conf.get(key, None) for key in wanted}
        try:
            for key, value in wanted.items():
                spark.conf.set(key, value)
            yield
        finally:
            for key, value in before.items():
                if value is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, value)
