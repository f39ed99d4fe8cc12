"""Strict replay of lateness: which events come after their window has closed."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.operators.stats import ADDITIVE, merge_aggregates
from marketpulse.operators.windows import trailing_from_changes, window_rows
from marketpulse.schemas import PRICE_SQ_SUM, PRICE_SUM

_HOUR = 60 * 60 * 1_000_000
_DAY = 24 * _HOUR


def with_stream_time(
    events: DataFrame,
    arrival: str,
    ts: str,
    tie: str = "event_id",
    scope: list[str] | None = None,
    slice_width: timedelta = timedelta(seconds=10),
) -> DataFrame:
    """Add ``stream_time``: the newest ``ts`` among this and all earlier arrivals.

    Arrivals are cut into time slices and each slice starts from the maximum of those
    before it, so a task sees single slices of events, never the whole stream. The slices'
    maxima are scanned by day, and each day starts from the maximum of the days before it;
    only one narrow row per day is scanned in one go. ``scope`` splits stream time, for
    example per source; None means one stream.
    """
    scope = scope or []
    width = int(slice_width.total_seconds() * 1_000_000)
    slice_no = F.floor(F.unix_micros(arrival) / F.lit(width))
    rows = events.withColumns({"_slice": slice_no, "_row": F.lit(1), "_ts": F.col(ts)})
    day = F.floor(F.col("_slice") * F.lit(width) / F.lit(_DAY)).alias("_day")
    peaks = rows.groupBy(*scope, "_slice").agg(F.max("_ts").alias("_peak")).select("*", day)
    opening = _openings(peaks, scope)
    so_far = (
        Window.partitionBy(*scope, "_slice")
        .orderBy("_row", arrival, tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    stacked = rows.unionByName(opening, allowMissingColumns=True)
    timed = stacked.withColumn("stream_time", F.max("_ts").over(so_far))
    return timed.filter(F.col("_row") == 1).drop("_row", "_slice", "_ts")


def _openings(peaks: DataFrame, scope: list[str]) -> DataFrame:
    """The newest time before each slice, as a row that stands in front of the slice."""
    before = lambda *keys: (
        Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    )
    days = peaks.groupBy(*scope, "_day").agg(F.max("_peak").alias("_peak"))
    newest = F.max("_peak").over(before(*scope).orderBy("_day")).alias("_peak")
    first = days.select(*scope, "_day", newest).withColumn("_own", F.lit(0))
    stacked = peaks.withColumn("_own", F.lit(1)).unionByName(first, allowMissingColumns=True)
    inside = F.max("_peak").over(before(*scope, "_day").orderBy("_own", "_slice"))
    timed = stacked.select(*scope, "_slice", "_own", inside.alias("_ts"))
    return timed.filter("_own = 1").select(*scope, "_slice", F.lit(0).alias("_row"), "_ts")


def with_lateness(timed: DataFrame, ts: str, window: str = "1 hour") -> DataFrame:
    """Add ``late``: the tumbling window of the event had closed when it arrived."""
    end = F.window(ts, window)["end"]
    return timed.withColumn("_end", end).withColumn(
        "late", F.col("_end") <= F.col("stream_time")
    ).drop("_end")


def drop_late(timed: DataFrame, ts: str, window: str = "1 hour") -> DataFrame:
    return with_lateness(timed, ts, window).filter(~F.col("late")).drop("late", "stream_time")


def _hour_of(micros: Column) -> Column:
    return micros - F.pmod(micros, F.lit(_HOUR))


def with_open_starts(timed: DataFrame, ts: str = "sold_at") -> DataFrame:
    """Add ``first_open`` and ``last_open``: starts of the 24-hour windows an event still reaches.

    An event lies in the 24 hourly windows that start up to its own hour. Those that end at or
    before stream time have closed, and they are the earliest ones, so what is left is one
    range: empty, with null bounds, for an event that is late for all of them.
    """
    first = _hour_of(F.unix_micros("stream_time") - _DAY) + _HOUR
    last = _hour_of(F.unix_micros(ts))
    open_ = first <= last
    return timed.withColumns(
        {
            "first_open": F.when(open_, F.timestamp_micros(first)),
            "last_open": F.when(open_, F.timestamp_micros(last)),
        }
    )


def trailing_aggregates(timed: DataFrame, ts: str = "sold_at") -> DataFrame:
    """Trailing 24-hour windows, each without the sales that came after it had closed.

    ``timed`` comes from :func:`with_stream_time`. A sale is two changes over window starts,
    clipped to the range still open when it arrived, not 24 copies; the changes of a ticker
    are added up per hour in the map tasks, so a ticker sends one row per hour and task
    however much it trades. Sales late for all their windows, or without a time, count nowhere.
    """
    price = F.col("price")
    own = [
        price.isNotNull().cast("long").alias("sample_count"),
        price.cast(PRICE_SUM).alias("price_sum"),
        (price * price).cast(PRICE_SQ_SUM).alias("price_sq_sum"),
        F.greatest("quantity", F.lit(0)).cast("long").alias("volume"),
    ]
    reached = with_open_starts(timed, ts).filter(F.col("first_open").isNotNull())
    sums = reached.select("market_key", "first_open", "last_open", *own)
    enter = F.struct(F.col("first_open").alias("at"), *ADDITIVE)
    after = (F.col("last_open") + F.expr("INTERVAL 1 HOUR")).alias("at")
    leave = F.struct(after, *[(-F.col(c)).alias(c) for c in ADDITIVE])
    changes = sums.select("market_key", F.inline(F.array(enter, leave)))
    hourly = changes.groupBy("market_key", "at").agg(*merge_aggregates())
    return window_rows(trailing_from_changes(hourly))
