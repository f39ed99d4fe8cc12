"""Hourly, daily and trailing-24-hour price windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.functions.keys import card_of
from marketpulse.operators.stats import (
    ADDITIVE,
    base_aggregates,
    merge_aggregates,
    price_volatility,
    typed,
)
from marketpulse.schemas import WINDOW_TYPES

# Window lengths; trailing windows hop by a pane.
LENGTHS = {"HOURLY": "1 hour", "DAILY": "1 day", "MA_24H": "24 hours"}
PANE = "1 hour"


def windowed_aggregates(
    sales: DataFrame, types: tuple[str, ...] = WINDOW_TYPES, ts: str = "sold_at"
) -> DataFrame:
    """One row per (ticker, window): average, volatility, volume and sample count.

    A single tumbling type aggregates the sales directly. Otherwise sales are folded into
    hourly panes once, and the panes serve all types.
    """
    unknown = set(types) - set(WINDOW_TYPES)
    if unknown or not types:
        raise ValueError(f"unknown window types: {sorted(unknown)}")
    if len(types) == 1 and types[0] != "MA_24H":
        return window_rows(_tumbling(sales, types[0], ts))
    panes = _tumbling(sales, "HOURLY", ts)
    builders = {"HOURLY": lambda df: df, "DAILY": _daily, "MA_24H": _trailing}
    parts = [builders[kind](panes) for kind in types]
    return window_rows(reduce(DataFrame.unionByName, parts))


def window_rows(sums: DataFrame) -> DataFrame:
    """Project summed windows to the price_window layout."""
    return price_volatility(sums).select(
        "market_key",
        card_of(F.col("market_key")).alias("card_id"),
        "window_type",
        "window_start",
        "window_end",
        "avg_price",
        "volatility",
        "volume",
        "sample_count",
    )


def settled(windows: DataFrame, sales: DataFrame, ts: str = "sold_at") -> DataFrame:
    """Windows that stream time (the newest sale) has closed; the open tail is left out."""
    return windows.filter(F.col("window_end") <= sales.agg(F.max(ts)).scalar())


def _tumbling(sales: DataFrame, kind: str, ts: str) -> DataFrame:
    grouped = sales.groupBy("market_key", F.window(ts, LENGTHS[kind]).alias("w"))
    return grouped.agg(*base_aggregates()).select(
        "market_key",
        F.lit(kind).alias("window_type"),
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        *ADDITIVE,
    )


def _daily(panes: DataFrame) -> DataFrame:
    """UTC days from hourly panes.

    The day is computed rather than taken from ``window()``, which would add a null filter
    to this branch only and so keep Spark from reusing the panes' shuffle.
    """
    day = F.timestamp_seconds(F.floor(F.unix_seconds("window_start") / 86400) * 86400)
    sums = panes.groupBy("market_key", day.alias("window_start")).agg(*merge_aggregates())
    return sums.select(
        "market_key",
        F.lit("DAILY").alias("window_type"),
        "window_start",
        (F.col("window_start") + F.expr("INTERVAL 24 HOURS")).alias("window_end"),
        *ADDITIVE,
    )


def _trailing(panes: DataFrame) -> DataFrame:
    """Hopping 24-hour windows from hourly panes.

    Seen over window starts, a pane enters 23 hours before its own hour and leaves one hour
    after it. Two changes per pane are summed up in order of start, exactly since the sums
    are decimal. Between changes the sums stay the same, so they are spread over the hourly
    starts only at the end: the shuffle carries two rows per pane instead of 24, and a
    ticker has at most two rows per hour however many sales it makes.
    """
    hour = F.expr("INTERVAL 1 HOUR")
    start = F.col("window_start")
    enter = F.struct((start - F.expr("INTERVAL 23 HOURS")).alias("at"), *ADDITIVE)
    leave = F.struct((start + hour).alias("at"), *[(-F.col(c)).alias(c) for c in ADDITIVE])
    changes = panes.select("market_key", F.inline(F.array(enter, leave)))
    return trailing_from_changes(changes)


def trailing_from_changes(changes: DataFrame) -> DataFrame:
    """24-hour windows from what enters and leaves (``market_key``, ``at``, sums) at each start."""
    hour = F.expr("INTERVAL 1 HOUR")
    in_order = Window.partitionBy("market_key").orderBy("at")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Of several changes at one start the last holds the full sums; the others are empty runs.
    runs = changes.select(
        "market_key",
        "at",
        F.lead("at").over(in_order).alias("until"),
        *[F.sum(c).over(so_far).alias(c) for c in ADDITIVE],
    ).filter((F.col("sample_count") > 0) & (F.col("until") > F.col("at")))
    starts = F.sequence("at", F.col("until") - hour, hour)
    return runs.select("market_key", F.explode(starts).alias("window_start"), *ADDITIVE).select(
        "market_key",
        F.lit("MA_24H").alias("window_type"),
        "window_start",
        (F.col("window_start") + F.expr("INTERVAL 24 HOURS")).alias("window_end"),
        *[typed(c) for c in ADDITIVE],
    )
