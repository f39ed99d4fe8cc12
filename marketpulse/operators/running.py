"""Statistics of everything a ticker traded before each event.

A plain running window per ticker would put all rows of the hottest ticker through one
task. All events are therefore range-partitioned by (ticker, time, tie), so that a ticker,
and even one instant of it, spreads over as many partitions as its rows fill. Each
partition's sums per ticker, folded over the partitions before it, are its opening balance,
and the running window works inside (ticker, partition). The result is exact because
decimal sums can be split anywhere.

Partitions are written once with their number, to the shared folder, because range bounds
come from a sample and must not be drawn twice. A ticker's opening balances are at most one
row per partition. They travel as one extra row in front of each run of rows, which avoids
a join.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.schemas import PRICE_SQ_SUM, PRICE_SUM
from marketpulse.session import shared_dir

SUMS = (("prior_count", "bigint"), ("prior_sum", PRICE_SUM), ("prior_sq_sum", PRICE_SQ_SUM))
_PARTS = (("_n", "bigint"), ("_s1", PRICE_SUM), ("_s2", PRICE_SQ_SUM))
#: Slice of the rows without a time.
_LAST = 2**63 - 1


def prior_stats(
    events: DataFrame,
    tie: list[str],
    key: str = "market_key",
    ts: str = "ts",
    counted: str = "counted",
    carry: DataFrame | None = None,
    slice_width: timedelta | None = None,
) -> DataFrame:
    """Add ``prior_count``, ``prior_sum`` and ``prior_sq_sum`` of ``price`` to each event.

    Only rows with ``counted`` true feed the sums; all rows receive them. ``prior_count`` is
    that of the rows, with a price or without. Rows are ordered by ``ts``, those without one
    last, and then by ``tie``, which must make the order unique. ``carry`` holds sums
    (key, prior_*) from before these events. The events are written when this is called.

    With ``slice_width`` nothing is written: a ticker is cut into slices of that much event
    time instead of ranges, which suits a micro-batch that is cached. One instant of a ticker
    then stays together.
    """
    in_time = F.col(ts).asc_nulls_last()
    if slice_width is None:
        rows = ranged(events, [key, in_time, *tie])
    else:
        width = F.lit(int(slice_width.total_seconds() * 1_000_000))
        part = F.greatest(F.floor(F.unix_micros(ts) / width), F.lit(0))
        rows = events.withColumn("_part", F.when(F.col(ts).isNull(), _LAST).otherwise(part))
    price = F.when(F.col(counted), F.col("price"))
    rows = rows.withColumns(
        {
            "_row": F.lit(1),
            "_n": F.when(F.col(counted), F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
            "_s1": F.coalesce(price, F.lit(0)).cast(PRICE_SUM),
            "_s2": F.coalesce(price * price, F.lit(0)).cast(PRICE_SQ_SUM),
        }
    )
    stacked = rows.unionByName(_opening_balances(rows, key, carry), allowMissingColumns=True)
    before = (
        Window.partitionBy(key, "_part")
        .orderBy("_row", in_time, *tie)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = [
        F.coalesce(F.sum(part).over(before), F.lit(0)).cast(dtype).alias(name)
        for (name, dtype), (part, _) in zip(SUMS, _PARTS)
    ]
    scored = stacked.select(*events.columns, "_row", *sums)
    return scored.filter(F.col("_row") == 1).drop("_row")


def ranged(events: DataFrame, order: list[str | Column]) -> DataFrame:
    """The events as written in ranges of ``order``, with the number of their range."""
    path = shared_dir(events.sparkSession, "running")
    parts = events.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts.write.parquet(path)
    return events.sparkSession.read.schema(parts.schema).parquet(path)


def batch_totals(events: DataFrame, key: str = "market_key", counted: str = "counted") -> DataFrame:
    """Sums of a whole batch per ticker, in the layout ``carry`` expects."""
    price = F.col("price")
    return (
        events.filter(F.col(counted))
        .groupBy(key)
        .agg(
            F.count(price).alias("prior_count"),
            F.sum(price).cast(PRICE_SUM).alias("prior_sum"),
            F.sum(price * price).cast(PRICE_SQ_SUM).alias("prior_sq_sum"),
        )
    )


def add_totals(left: DataFrame, right: DataFrame, key: str = "market_key") -> DataFrame:
    both = left.unionByName(right)
    sums = [F.sum(name).cast(dtype).alias(name) for name, dtype in SUMS]
    return both.groupBy(key).agg(*sums)


def _opening_balances(rows: DataFrame, key: str, carry: DataFrame | None) -> DataFrame:
    """One row per ticker and range that does not start from nothing."""
    folded = rows.groupBy(key, "_part").agg(
        *[F.sum(name).cast(dtype).alias(name) for name, dtype in _PARTS]
    )
    if carry is not None:
        # Carried sums stand before the first range.
        brought = carry.select(
            key,
            F.lit(-1).alias("_part"),
            *[F.col(total).alias(part) for (total, _), (part, _) in zip(SUMS, _PARTS)],
        )
        folded = folded.unionByName(brought)
    earlier = (
        Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    balances = folded.select(
        key, "_part", *[F.sum(c).over(earlier).cast(t).alias(c) for c, t in _PARTS]
    )
    return balances.filter("_n > 0 AND _part >= 0").withColumn("_row", F.lit(0))
