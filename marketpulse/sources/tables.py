"""Serving tables stored as parquet, plain or as change logs by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketpulse.operators.merge import Order, first_per_key, last_per_key, rows_like, upsert
from marketpulse.schemas import ALERT, MARKET_SNAPSHOT, PRICE_WINDOW
from marketpulse.session import shared_dir


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a change log with the ``batch_id`` that wrote them."""
    columns = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(columns).parquet(path)


def current_rows(log: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert semantics: the newest batch wins."""
    return last_per_key(log, keys, ["batch_id"]).drop("batch_id")


def first_rows(log: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-if-absent semantics: the oldest batch wins."""
    return first_per_key(log, keys, ["batch_id"]).drop("batch_id")


def window_day() -> Column:
    """Partition column of stored price windows."""
    return F.to_date("window_start").alias("window_date")


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def upsert_table(
    delta: DataFrame,
    path: str,
    keys: Sequence[str],
    partition_by: Sequence[str],
    order: Order | None = None,
) -> None:
    """Upsert ``delta`` into a partitioned table; partitions it does not touch stay as they are.

    The partition columns must follow from the keys; a null in either equals a null. Of several rows of ``delta`` with one key
    the last by ``order`` wins. The touched partitions are merged into a shared scratch folder
    first, because a table cannot be read while it is overwritten; running again after a
    failure gives the same table. A table that does not exist begins empty.
    """
    spark = delta.sparkSession
    fresh = last_per_key(delta, keys, order) if order else delta
    drop = [c for c in order or () if isinstance(c, str) and c not in keys]
    columns = [c for c in fresh.columns if c not in drop]
    fresh = fresh.select(*columns)
    if exists(spark, path):
        base = spark.read.schema(fresh.schema).parquet(path).select(*columns)
        parts = fresh.select(*partition_by).distinct()
        touched = rows_like(base, parts, partition_by, "left_semi").select(*columns)
        merged = upsert(touched, fresh, keys)
        scratch = shared_dir(spark, "upsert")
        merged.write.parquet(scratch)
        fresh = spark.read.schema(fresh.schema).parquet(scratch)
    writer = fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def read_price_windows(spark: SparkSession, path: str) -> DataFrame:
    log = read_log(spark, path, PRICE_WINDOW)
    return current_rows(log, ["market_key", "window_type", "window_start"])


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return first_rows(read_log(spark, path, ALERT), ["alert_id"])


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return current_rows(read_log(spark, path, MARKET_SNAPSHOT), ["market_key"])
