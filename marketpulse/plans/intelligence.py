"""Clean sales and listings to windows, alerts and market state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from marketpulse.operators import alerts, signals, stats, windows
from marketpulse.schemas import Thresholds
from marketpulse.sources.tables import window_day


@dataclass(frozen=True)
class Intelligence:
    price_windows: DataFrame
    alerts: DataFrame
    snapshot: DataFrame


def market_intelligence(
    sales: DataFrame,
    listings: DataFrame,
    metadata: DataFrame,
    limits: Thresholds = Thresholds(),
) -> Intelligence:
    """All derived tables, lazily; only settled windows are included."""
    found = signals.market_alerts(sales, listings, limits)
    return Intelligence(
        price_windows=windows.settled(windows.windowed_aggregates(sales), sales),
        alerts=alerts.enrich(found, metadata),
        snapshot=stats.market_snapshot(sales),
    )


def write(result: Intelligence, path: str) -> None:
    """Write the derived tables in the layout the serving queries read best."""
    windows_ = result.price_windows.withColumn("window_date", window_day())
    windows_.write.mode("overwrite").partitionBy("window_type", "window_date").parquet(
        f"{path}/price_window"
    )
    result.alerts.write.mode("overwrite").partitionBy("type").parquet(f"{path}/alert")
    result.snapshot.write.mode("overwrite").parquet(f"{path}/snapshot")
