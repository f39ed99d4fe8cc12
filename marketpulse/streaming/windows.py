"""Settled price windows from a live sales stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketpulse.operators.stats import base_aggregates
from marketpulse.operators.windows import LENGTHS, PANE, window_rows
from marketpulse.schemas import WINDOW_TYPES
from marketpulse.streaming.keyed import trailing_windows
from marketpulse.streaming.sinks import batch_writer, start

#: No grace: a window closes as soon as event time reaches its end.
GRACE = "0 seconds"


def stream_windows(sales: DataFrame, kind: str, ts: str = "sold_at") -> DataFrame:
    """One row per closed window, for append mode.

    MA_24H goes on from hourly panes, of which each ticker keeps the last 24 in its state.
    """
    if kind not in WINDOW_TYPES:
        raise ValueError(f"unknown window type: {kind}")
    marked = sales.withWatermark(ts, GRACE)
    if kind == "MA_24H":
        panes = marked.groupBy("market_key", F.window(ts, PANE)).agg(*base_aggregates())
        sums = trailing_windows(panes)
    else:
        span = F.window(ts, LENGTHS[kind]).alias("w")
        sums = marked.groupBy("market_key", span).agg(*base_aggregates())
    named = sums.select(
        "market_key",
        F.lit(kind).alias("window_type"),
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "sample_count", "price_sum", "price_sq_sum", "volume",
    )
    return window_rows(named)


def start_windows(
    sales: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> list[StreamingQuery]:
    """One query per window type, each with its own folder of the price_window log."""
    return [
        start(
            stream_windows(sales, kind).drop("window_type"),
            batch_writer(f"{path}/window_type={kind}"),
            f"{checkpoint}/{kind.lower()}",
            every=every,
        )
        for kind in WINDOW_TYPES
    ]
