"""Consecutive numbers in a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.session import shared_dir


def consecutive_ids(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """Number rows by ``order`` (unique) from ``first`` on.

    Rows are range-partitioned by the order and written once with their partition number,
    because range bounds come from a sample and must not be drawn twice. Each partition is
    then numbered on its own and shifted by the sizes of those before it; only these sizes,
    one row per partition, pass through a single task.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "ranges")
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(path)
    parts = spark.read.parquet(path)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = parts.withColumn("_row", inside).join(shifts, "_part")
    ids = (F.col("_shift") + F.col("_row") + F.lit(first - 1)).cast("long")
    return numbered.withColumn(name, ids).drop("_part", "_row", "_shift")
