"""Per-ticker price statistics as mergeable sums.

Every buffer is fixed-width, so Spark folds them with hash aggregation: partial sums in
the map task, one narrow row per ticker and task over the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions import money
from marketpulse.functions.keys import card_of
from marketpulse.schemas import MONEY, PRICE_SQ_SUM, PRICE_SUM

#: Sums that two partial results may simply add.
ADDITIVE = ("sample_count", "price_sum", "price_sq_sum", "volume")

# The newest sale packed as one number, time first and cents last: a plain MAX keeps it,
# where max_by over a struct would force sort-based aggregation. Sales of the same ticker
# in the same microsecond are ordered by price.
_CENTS_ROOM = 10**12


def base_aggregates(price: str = "price", quantity: str = "quantity") -> list[Column]:
    p = F.col(price)
    return [
        F.count(p).alias("sample_count"),
        F.sum(p).cast(PRICE_SUM).alias("price_sum"),
        F.sum(p * p).cast(PRICE_SQ_SUM).alias("price_sq_sum"),
        F.sum(F.greatest(F.col(quantity), F.lit(0)).cast("long")).alias("volume"),
    ]


_TYPES = {"price_sum": PRICE_SUM, "price_sq_sum": PRICE_SQ_SUM}


def typed(name: str) -> Column:
    """An additive column in its own type, which sums of decimals outgrow."""
    return F.col(name).cast(_TYPES.get(name, "long")).alias(name)


def merge_aggregates() -> list[Column]:
    return [F.sum(c).cast(_TYPES.get(c, "long")).alias(c) for c in ADDITIVE]


def market_stats(sales: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All-time accumulator per ticker: count, sums, extremes, last sale, volume."""
    stats = sales.groupBy(*(keys or ["market_key"])).agg(
        *base_aggregates(),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.max(packed_sale(F.unix_micros("sold_at"), F.col("price"))).alias("_last"),
    )
    return unpacked_sale(stats)


def _room() -> Column:
    return F.lit(_CENTS_ROOM).cast("decimal(13,0)")


def packed_sale(micros: Column, price: Column) -> Column:
    return micros.cast("decimal(17,0)") * _room() + (price * 100).cast("decimal(12,0)")


def unpacked_sale(stats: DataFrame) -> DataFrame:
    """``last_price`` and ``last_trade_at`` from the newest packed sale, ``_last``."""
    room = _room()
    micros = F.floor(F.col("_last") / room)
    return stats.withColumns(
        {
            "last_price": ((F.col("_last") - micros * room) / 100).cast(MONEY),
            "last_trade_at": F.timestamp_micros(micros.cast("long")),
        }
    ).drop("_last")


def price_volatility(stats: DataFrame) -> DataFrame:
    """Mean and population standard deviation from the sums."""
    n, s1, s2 = F.col("sample_count"), F.col("price_sum"), F.col("price_sq_sum")
    return stats.withColumns(
        {"avg_price": money.mean_price(s1, n), "volatility": money.stddev(n, s1, s2)}
    )


def market_snapshot(sales: DataFrame) -> DataFrame:
    """Current market state per ticker."""
    return snapshot_view(market_stats(sales))


def snapshot_view(stats: DataFrame) -> DataFrame:
    parts = F.split("market_key", r"\|", 3)
    return price_volatility(stats).select(
        "market_key",
        card_of(F.col("market_key")).alias("card_id"),
        F.get(parts, F.lit(1)).alias("finish"),
        F.get(parts, F.lit(2)).alias("condition"),
        "last_price",
        "last_trade_at",
        "avg_price",
        "volatility",
        "volume",
        "sample_count",
    )
