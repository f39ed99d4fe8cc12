"""Live market state per ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from marketpulse.operators.stats import market_snapshot
from marketpulse.streaming.keyed import keep_market_state
from marketpulse.streaming.sinks import batch_writer, launch, start


def start_snapshot(
    sales: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Write the new state of each ticker touched by a batch to a change log."""
    return start(market_snapshot(sales), batch_writer(path), checkpoint, mode="update", every=every)


def start_state(sales: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep the market state in the query's own state and write no log.

    ``keyed.market_state`` reads it, as of the last batch, while the query runs or after.
    """
    writer = keep_market_state(sales).writeStream.format("noop")
    return launch(sales.sparkSession, writer, checkpoint, mode="update", every=every)
