"""Questions asked of the serving tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.functions import keys
from marketpulse.operators.catalog import CARD_VIEW
from marketpulse.operators.merge import last_per_key
from marketpulse.schemas import CONDITIONS, FINISHES

_HISTORY = {"hourly": "HOURLY", "daily": "DAILY"}
_DIRECTIONS = ("gainers", "losers")


def window_type_of(window: str) -> str:
    try:
        return _HISTORY[window.lower()]
    except KeyError:
        raise ValueError("window must be hourly or daily") from None


def direction_of(direction: str) -> str:
    if direction.lower() not in _DIRECTIONS:
        raise ValueError("dir must be gainers or losers")
    return direction.lower()


def price_history(
    windows: DataFrame,
    card_id: str | None = None,
    window: str = "hourly",
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    cards: DataFrame | None = None,
) -> DataFrame:
    """Windows of every ticker of a card in time order, both bounds inclusive.

    ``cards`` asks for the history of many cards at once; without either, of all cards.
    """
    rows = windows.filter(F.col("window_type") == window_type_of(window))
    if card_id is not None:
        rows = rows.filter(F.col("market_key").startswith(card_id + "|"))
    if cards is not None:
        wanted = cards.select("card_id")
        rows = rows.join(wanted, "card_id", "left_semi").select(*windows.columns)
    if start is not None:
        rows = rows.filter(F.col("window_start") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("window_start") <= F.lit(end))
    return rows.orderBy("window_start", "market_key")


def price_change(windows: DataFrame) -> DataFrame:
    """Each window next to the average of the ticker's previous existing window."""
    in_order = Window.partitionBy("market_key", "window_type").orderBy("window_start")
    return windows.withColumn("prev_avg_price", F.lag("avg_price").over(in_order))


def latest_window(windows: DataFrame) -> DataFrame:
    return last_per_key(windows, ["market_key", "window_type"], ["window_start"])


def top_movers(
    windows: DataFrame,
    cards: DataFrame,
    window: str = "daily",
    direction: str = "gainers",
    limit: int = 20,
) -> DataFrame:
    """Largest relative change between a ticker's last two windows.

    Only the last two windows per ticker are needed, so the rank filter comes first: it is
    applied in the map tasks and the shuffle carries at most two rows per ticker and task.
    """
    newest_first = Window.partitionBy("market_key").orderBy(F.desc("window_start"))
    kind = windows.filter(F.col("window_type") == window_type_of(window))
    last_two = kind.withColumn("_rank", F.row_number().over(newest_first)).filter("_rank <= 2")
    pairs = last_two.groupBy("market_key").agg(
        F.max(F.when(F.col("_rank") == 1, F.col("avg_price"))).alias("avg_price"),
        F.max(F.when(F.col("_rank") == 2, F.col("avg_price"))).alias("prev_avg_price"),
    )
    moved = pairs.filter(F.col("prev_avg_price").isNotNull() & (F.col("prev_avg_price") != 0))
    now, prev = F.col("avg_price").cast("double"), F.col("prev_avg_price").cast("double")
    named = moved.select(
        "market_key",
        keys.card_of(F.col("market_key")).alias("card_id"),
        "avg_price",
        "prev_avg_price",
        ((now - prev) / prev).alias("pct_change"),
    ).join(cards.select("card_id", F.col("name").alias("card_name")), "card_id")
    pct = F.col("pct_change")
    order = pct.desc() if direction_of(direction) == "gainers" else pct.asc()
    columns = [
        "market_key", "card_id", "card_name", "avg_price", "prev_avg_price", "pct_change",
    ]
    return named.select(*columns).orderBy(order, "market_key").limit(limit)


def ticker_snapshot(snapshots: DataFrame, wanted: DataFrame) -> DataFrame:
    """Answer each asked ticker (column ``asked``) with its snapshot.

    ``answer`` is ``invalid`` for text that is no ticker, ``missing`` for a ticker without
    trades and ``found`` otherwise.
    """
    asked = wanted.select("asked").distinct()
    parsed = asked.withColumn("_valid", keys.parse_market_key(F.col("asked"))["valid"])
    joined = parsed.join(snapshots, F.col("asked") == F.col("market_key"), "left")
    answer = (
        F.when(~F.col("_valid"), F.lit("invalid"))
        .when(F.col("market_key").isNull(), F.lit("missing"))
        .otherwise(F.lit("found"))
    )
    return joined.withColumn("answer", answer).select("asked", "answer", *snapshots.columns)


def card_detail(card_views: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Catalogue row and current state of each ticker of each card, in enumeration order."""
    traded = snapshots.filter(
        F.col("finish").isin(*FINISHES)
        & F.col("condition").isin(*CONDITIONS)
        & (F.col("sample_count") > 0)
    ).withColumn(
        "position",
        (
            (keys.ordinal(F.col("finish"), FINISHES) - 1) * len(CONDITIONS)
            + keys.ordinal(F.col("condition"), CONDITIONS)
        ).cast("long"),
    )
    return card_views.join(traded, "card_id", "left").orderBy("card_id", "position")


def watchlist_cards(watchlist: DataFrame, card_views: DataFrame) -> DataFrame:
    """Watched cards per user in the order they were added."""
    rows = watchlist.join(card_views, "card_id")
    return rows.select("user_id", "created_at", *CARD_VIEW).orderBy(
        "user_id", "created_at", "card_id"
    )


def watchlist_alerts(alerts: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Alerts on cards that are on the watchlist."""
    return alerts.join(watchlist.select("card_id"), "card_id", "left_semi").select(*alerts.columns)


def scoped_alerts(
    alerts: DataFrame, watchlist: DataFrame, user_id: str | None = None
) -> DataFrame:
    """What one user is shown; without a user, everything."""
    if user_id is None:
        return alerts
    return watchlist_alerts(alerts, watchlist.filter(F.col("user_id") == user_id))


def watchlist_fanout(alerts: DataFrame, watchlist: DataFrame) -> DataFrame:
    """One row per (user, alert) to deliver."""
    rows = alerts.join(watchlist.select("user_id", "card_id"), "card_id")
    return rows.select("user_id", *alerts.columns)
