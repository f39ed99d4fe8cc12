"""Statistics, windows, signals and alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketpulse.operators import alerts, merge, serving, signals, stats, windows
from marketpulse.session import shared_dir
from marketpulse.sources.tables import upsert_table, window_day
from workload.checks import CENTS, WINDOW_COLUMNS, half_up, windows_sql
from workload.registry import query
from workload.tables import card_views, catalogue, price_windows, rounded, snapshots

_WINDOW = (
    "market_key, card_id, window_type, window_start, window_end, avg_price, volatility, volume, "
    "sample_count"
)

# ---- statistics


def _stats_sql(view: str) -> str:
    return f"""
        SELECT market_key, count(*) AS sample_count, CAST(sum(price) AS DOUBLE) AS price_sum,
               CAST(sum({CENTS} * {CENTS}) AS DOUBLE) / 10000.0 AS price_sq_sum,
               CAST(sum(greatest(quantity, 0)) AS BIGINT) AS volume,
               CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price,
               CAST(arg_max(price, (sold_at, price)) AS DOUBLE) AS last_price,
               max(sold_at) AS last_trade_at
        FROM {view} GROUP BY market_key"""


@query("market_stats", "sales", _stats_sql("sales"))
def market_stats(f):
    return stats.market_stats(f.sales)


@query("market_stats_bulk", "bulk_sales", _stats_sql("bulk_sales"))
def market_stats_bulk(f):
    return stats.market_stats(f.bulk_sales)


@query(
    "price_volatility",
    "sales",
    f"SELECT market_key, {WINDOW_COLUMNS} FROM sales GROUP BY market_key",
)
def price_volatility(f):
    rows = rounded(stats.price_volatility(stats.market_stats(f.sales)))
    return rows.select("market_key", "avg_price", "volatility", "volume", "sample_count")


@query(
    "reference_stats",
    "brand_sales",
    f"SELECT market_key, {WINDOW_COLUMNS} FROM brand_sales GROUP BY market_key",
)
def reference_stats(f):
    sums = f.brand_sales.groupBy("market_key").agg(*stats.base_aggregates())
    rows = rounded(stats.price_volatility(sums))
    return rows.select("market_key", "avg_price", "volatility", "volume", "sample_count")


_SNAPSHOT = (
    "market_key, card_id, finish, condition, last_price, last_trade_at, avg_price, volatility, "
    "volume, sample_count"
)


@query("market_snapshot", "snapshot", f"SELECT {_SNAPSHOT} FROM snapshot")
def market_snapshot(f):
    return rounded(snapshots(f))


# ---- windows


def _one_kind(view: str, kind: str):
    return lambda f: rounded(windows.windowed_aggregates(getattr(f, view), (kind,)))


for _name, _view, _kind in (
    ("hourly_aggregates", "sales", "HOURLY"),
    ("daily_aggregates", "sales", "DAILY"),
    ("ma_24h_aggregates", "sales", "MA_24H"),
    ("daily_aggregates_bulk", "bulk_sales", "DAILY"),
):
    query(_name, _view, windows_sql(_view, _kind))(_one_kind(_view, _kind))


@query(
    "ma_24h_aggregates_bulk",
    "brand_sales",
    f"""SELECT market_key, count(*) AS windows, CAST(sum(sample_count) AS BIGINT) AS samples,
               min(avg_price) AS lowest, max(avg_price) AS highest, max(volatility) AS wildest
        FROM ({windows_sql("brand_sales", "MA_24H")}) w GROUP BY market_key""",
)
def ma_24h_aggregates_bulk(f):
    """Range of the trailing average of each brand ticker over its whole history."""
    trailing = rounded(windows.windowed_aggregates(f.brand_sales, ("MA_24H",)))
    return trailing.groupBy("market_key").agg(
        F.count("*").alias("windows"),
        F.sum("sample_count").alias("samples"),
        F.min("avg_price").alias("lowest"),
        F.max("avg_price").alias("highest"),
        F.max("volatility").alias("wildest"),
    )


@query("all_windows", "price_windows", f"SELECT {_WINDOW} FROM price_windows")
def all_windows(f):
    return rounded(price_windows(f))


@query("settled_windows", "settled_windows", f"SELECT {_WINDOW} FROM settled_windows")
def settled_windows(f):
    return rounded(windows.settled(price_windows(f), f.sales))


@query(
    "price_change",
    "price_windows",
    """SELECT market_key, window_type, window_start, avg_price, lag(avg_price) OVER (
              PARTITION BY market_key, window_type ORDER BY window_start) AS prev_avg_price
       FROM price_windows""",
)
def price_change(f):
    changed = serving.price_change(price_windows(f))
    return changed.select("market_key", "window_type", "window_start", "avg_price", "prev_avg_price")


@query(
    "latest_window",
    "price_windows",
    f"""SELECT {_WINDOW} FROM price_windows
        QUALIFY row_number() OVER (PARTITION BY market_key, window_type
                                   ORDER BY window_start DESC) = 1""",
)
def latest_window(f):
    return rounded(serving.latest_window(price_windows(f)))


def _movers_sql(order: str) -> str:
    return f"""
        SELECT t.market_key, t.card_id, c.name AS card_name, t.two[1] AS avg_price,
               t.two[2] AS prev_avg_price, (t.two[1] - t.two[2]) / t.two[2] AS pct_change
        FROM (SELECT market_key, min(card_id) AS card_id,
                     list(avg_price ORDER BY window_start DESC)[1:2] AS two
              FROM daily GROUP BY market_key) t
        JOIN cards c ON c.card_id = t.card_id
        WHERE len(t.two) = 2 AND t.two[2] <> 0
        ORDER BY pct_change {order}, t.market_key LIMIT 20"""


def _movers(f, direction: str):
    daily = windows.windowed_aggregates(f.sales, ("DAILY",))
    return serving.top_movers(daily, catalogue(f).cards, "daily", direction)


@query("top_gainers", "daily cards", _movers_sql("DESC"))
def top_gainers(f):
    return _movers(f, "gainers")


@query("top_losers", "daily cards", _movers_sql("ASC"))
def top_losers(f):
    return _movers(f, "losers")


@query("price_history", "hourly", f"SELECT {_WINDOW} FROM hourly")
def price_history(f):
    hourly = windows.windowed_aggregates(f.sales, ("HOURLY",))
    return rounded(serving.price_history(hourly, window="hourly"))


@query(
    "card_price_history",
    "daily watchlist",
    f"""SELECT {_WINDOW} FROM daily WHERE card_id IN (SELECT card_id FROM watchlist)
        AND window_start BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""",
)
def card_price_history(f):
    """History of all watched cards between two days."""
    daily = windows.windowed_aggregates(f.sales, ("DAILY",))
    first, last = (dt.datetime(2024, 1, day, tzinfo=dt.UTC) for day in (5, 20))
    return rounded(
        serving.price_history(daily, None, "Daily", first, last, cards=f.watchlist)
    )


@query(
    "upsert_price_window",
    "daily settled_windows",
    """SELECT * FROM (WITH again AS (
          SELECT market_key, window_type, window_start, window_end, avg_price + 1 AS avg_price,
                 sample_count
          FROM settled_windows WHERE window_type = 'DAILY' AND volume >= 3),
        stored AS (
          SELECT market_key, window_type, window_start, window_end, avg_price, sample_count
          FROM daily WHERE avg_price < 400)
        SELECT * FROM again
        UNION ALL SELECT * FROM stored s WHERE NOT EXISTS (
          SELECT 1 FROM again a
          WHERE a.market_key = s.market_key AND a.window_start = s.window_start)) merged""",
)
def upsert_price_window(f):
    """Cheap daily windows are stored; then settled ones with some volume arrive twice.

    The second arrival counts. Some replace stored windows, some are new, and others stay.
    """
    columns = [
        "market_key", "window_type", "window_start", "window_end", "avg_price", "sample_count",
    ]
    keys = ["market_key", "window_type", "window_start"]
    parts = ["window_type", "window_date"]
    daily = windows.windowed_aggregates(f.sales, ("DAILY",))
    daily = daily.withColumns({"avg_price": F.col("avg_price").cast("double"), "window_date": window_day()})
    table = shared_dir(f.spark, "price-window")
    upsert_table(daily.filter("avg_price < 400").select(*columns, "window_date"), table, keys, parts)
    settled = windows.settled(daily, f.sales).filter("volume >= 3").select(*columns, "window_date")
    twice = settled.withColumn("version", F.explode(F.array(F.lit(1), F.lit(0))))
    raised = F.col("avg_price") + F.when(F.col("version") == 1, 1).otherwise(7)
    upsert_table(twice.withColumn("avg_price", raised), table, keys, parts, ["version"])
    return f.spark.read.schema(daily.select(*columns).schema).parquet(table).select(*columns)


# ---- signals


def _score_sql(digits: int = 4) -> str:
    """Double arithmetic on currency units, step by step as the operator does it."""
    spread = "CAST(n * s2 - s1 * s1 AS DOUBLE) / 10000.0"
    mean = half_up("s1", "(n * 100)", digits)
    return f"""event_id, market_key, ts, n AS prior_count,
        CASE WHEN n > 0 THEN {mean} ELSE 0.0 END AS mean,
        CASE WHEN n > 1 THEN round(sqrt({spread}) / n, {digits}) ELSE 0.0 END AS stddev,
        CASE WHEN n * s2 - s1 * s1 > 0 THEN round(abs(CAST(n * c - s1 AS DOUBLE) / 100.0)
             / sqrt({spread}), {digits}) END AS sigma"""


def _scores(sales, digits: int = 4):
    scored = rounded(signals.spike_scores(sales), digits, "mean", "stddev", "sigma")
    return scored.select("event_id", "market_key", "ts", "prior_count", "mean", "stddev", "sigma")


@query(
    "spike_scores",
    "market_events",
    f"SELECT {_score_sql()} FROM market_events WHERE kind = 'sale'",
)
def spike_scores(f):
    return _scores(f.sales)


_BRAND_EVENTS = f"""
    SELECT event_id, market_key, sold_at AS ts, c, count(*) OVER w AS n,
           coalesce(sum(c) OVER w, 0) AS s1, coalesce(sum(c * c) OVER w, 0) AS s2
    FROM (SELECT *, {CENTS} AS c FROM brand_sales) b
    WINDOW w AS (PARTITION BY market_key ORDER BY sold_at, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("spike_scores_bulk", "brand_sales", f"SELECT {_score_sql()} FROM ({_BRAND_EVENTS}) e")
def spike_scores_bulk(f):
    return _scores(f.brand_sales)


_SPIKE = "event_id, market_key, card_id, ts, price, mean, stddev, sigma, sample_count, severity"


@query("spike_events", "spikes", f"SELECT {_SPIKE} FROM spikes")
def spike_events(f):
    found = rounded(signals.spike_events(f.sales), 4, "mean", "stddev", "sigma")
    return found.withColumn("sample_count", F.col("prior_count")).select(*_SPIKE.split(", "))


_FLAG = (
    "event_id, market_key, card_id, finish, condition, source, seller_id, listing_price, "
    "reference_avg, discount_pct, sample_count, detected_at"
)


@query("arbitrage_flags", "flags", f"SELECT {_FLAG} FROM flags")
def arbitrage_flags(f):
    return signals.arbitrage_flags(f.sales, f.listings)


def _alerts(f):
    return signals.market_alerts(f.sales, f.listings)


def _named(f):
    return alerts.enrich(_alerts(f), catalogue(f).metadata)


@query(
    "spike_alerts",
    "spikes",
    """SELECT event_id, 'SPIKE' AS type, severity, card_id, market_key, ts, price, mean, stddev,
              sigma, sample_count AS "sampleCount" FROM spikes""",
)
def spike_alerts(f):
    found = signals.market_alerts(f.sales, None)
    return alerts.parse_detail(found, "SPIKE").drop("alert_id", "name")


@query(
    "arbitrage_alerts",
    "flags",
    """SELECT event_id, 'ARBITRAGE' AS type, CASE WHEN discount_pct >= 0.40 THEN 'HIGH'
              WHEN discount_pct >= 0.25 THEN 'MED' ELSE 'LOW' END AS severity, card_id,
              market_key, detected_at AS ts, listing_price AS "listingPrice",
              reference_avg AS "referenceAvg", discount_pct AS "discountPct",
              sample_count AS "sampleCount", seller_id AS "sellerId" FROM flags""",
)
def arbitrage_alerts(f):
    return alerts.parse_detail(_alerts(f), "ARBITRAGE").drop("alert_id", "name")


@query(
    "alert_detail_json",
    "flags spikes",
    """SELECT event_id, listing_price AS price, discount_pct AS size FROM flags
       UNION ALL SELECT event_id, price, sigma FROM spikes""",
)
def alert_detail_json(f):
    return alerts.with_variant_detail(_alerts(f)).select(
        "event_id",
        alerts.detail_field("price", "listingPrice").alias("price"),
        alerts.detail_field("sigma", "discountPct").alias("size"),
    )


@query(
    "alert_severity",
    "flags spikes",
    """SELECT event_id, severity FROM spikes
       UNION ALL SELECT event_id, CASE WHEN discount_pct >= 0.40 THEN 'HIGH'
                        WHEN discount_pct >= 0.25 THEN 'MED' ELSE 'LOW' END FROM flags""",
)
def alert_severity(f):
    return _alerts(f).select("event_id", "severity")


_ALERT = "event_id, type, severity, card_id, market_key, name, ts"
_ALERT_COLUMNS = _ALERT.split(", ")


@query("all_alerts", "alerts", f"SELECT {_ALERT} FROM alerts")
def all_alerts(f):
    return _named(f).select(*_ALERT_COLUMNS)


@query(
    "enriched_alerts",
    "alerts card_views",
    """SELECT event_id, a.card_id, a.name, v.name IS NOT NULL AS catalogued FROM alerts a
       LEFT JOIN card_views v ON a.card_id = v.card_id""",
)
def enriched_alerts(f):
    named = _named(f)
    return named.select(
        "event_id", "card_id", "name", F.col("name").isNotNull().alias("catalogued")
    )


def _branch(severity: str):
    return lambda f: alerts.with_severity(_named(f), severity).select(*_ALERT_COLUMNS)


for _severity in ("HIGH", "MED", "LOW"):
    query(
        f"alerts_{_severity.lower()}",
        "alerts",
        f"SELECT {_ALERT} FROM alerts WHERE severity = '{_severity}'",
    )(_branch(_severity))


@query(
    "alert_counts",
    "alerts",
    "SELECT type, severity, count(*) AS alerts FROM alerts GROUP BY type, severity",
)
def alert_counts(f):
    return alerts.alert_counts(_alerts(f))


@query("spike_counts", "spikes", "SELECT severity, count(*) AS spikes FROM spikes GROUP BY severity")
def spike_counts(f):
    return alerts.spike_counts(signals.market_alerts(f.sales, None))


# Ids are hashes, which decide ties of the newest-first order; event times here are unique.
@query(
    "recent_alerts",
    "alerts",
    f"SELECT {_ALERT} FROM alerts WHERE severity = 'HIGH' ORDER BY ts DESC LIMIT 50",
)
def recent_alerts(f):
    return alerts.recent(_named(f), severity="HIGH").select(*_ALERT_COLUMNS)


@query(
    "recent_arbitrage",
    "alerts",
    f"SELECT {_ALERT} FROM alerts WHERE type = 'ARBITRAGE' ORDER BY ts DESC LIMIT 50",
)
def recent_arbitrage(f):
    return alerts.recent(_named(f), kind="ARBITRAGE").select(*_ALERT_COLUMNS)


@query(
    "insert_if_absent_alert",
    "alerts",
    """SELECT event_id, CASE WHEN type = 'SPIKE' THEN 'stored' ELSE 'new' END AS origin
       FROM alerts""",
)
def insert_if_absent_alert(f):
    """Spikes are stored; all alerts are delivered twice; stored rows stay as they are."""
    found = _alerts(f).select("alert_id", "event_id", "type")
    stored = found.filter(F.col("type") == "SPIKE").withColumn("origin", F.lit("stored"))
    delivered = found.withColumn("origin", F.lit("new"))
    twice = delivered.unionByName(delivered)
    merged = merge.insert_if_absent(stored, twice, ["alert_id"], ["event_id"])
    return merged.select("event_id", "origin")


@query(
    "alert_feed_merge",
    "alerts",
    """SELECT event_id, type, severity, ts,
              CASE WHEN type = 'SPIKE' THEN 'live' ELSE 'stored' END AS origin
       FROM alerts ORDER BY ts DESC LIMIT 100""",
)
def alert_feed_merge(f):
    found = _alerts(f)
    live = found.filter(F.col("type") == "SPIKE").withColumn("origin", F.lit("live"))
    stored = found.withColumn("origin", F.lit("stored"))
    merged = alerts.merge_feed(live, stored)
    return merged.select("event_id", "type", "severity", "ts", "origin")


# ---- cards, tickers and watchlists


@query(
    "card_detail",
    "card_views snapshot",
    f"""SELECT v.card_id, v.name, v.set_name, s.market_key, s.finish, s.condition, s.last_price,
               s.avg_price, s.volatility, s.sample_count,
               CAST((list_position(['NORMAL', 'HOLOFOIL', 'REVERSE_HOLOFOIL'], s.finish) - 1) * 5
                    + list_position(['NM', 'LP', 'MP', 'HP', 'DMG'], s.condition) AS BIGINT)
                   AS position
        FROM card_views v LEFT JOIN snapshot s ON v.card_id = s.card_id""",
)
def card_detail(f):
    detail = rounded(serving.card_detail(card_views(f), snapshots(f)))
    return detail.select(
        "card_id", "name", "set_name", "market_key", "finish", "condition", "last_price",
        "avg_price", "volatility", "sample_count", "position",
    )


@query(
    "ticker_snapshot",
    "listings snapshot",
    """SELECT asked, CASE WHEN NOT valid THEN 'invalid' WHEN s.market_key IS NULL THEN 'missing'
                     ELSE 'found' END AS answer, s.last_price, s.sample_count
       FROM (SELECT DISTINCT market_key AS asked, true AS valid FROM listings
             UNION ALL SELECT DISTINCT 'x' || market_key, true FROM listings
             UNION ALL SELECT DISTINCT market_key || '?', false FROM listings) a
       LEFT JOIN snapshot s ON a.asked = s.market_key""",
)
def ticker_snapshot(f):
    key = F.col("market_key")
    texts = F.array(key, F.concat(F.lit("x"), key), F.concat(key, F.lit("?")))
    asked = f.listings.select(F.explode(texts).alias("asked"))
    answers = serving.ticker_snapshot(snapshots(f), asked)
    return answers.select("asked", "answer", "last_price", "sample_count")


@query(
    "watchlist_cards",
    "watchlist card_views",
    """SELECT w.user_id, w.created_at, v.card_id, v.name, v.set_name FROM watchlist w
       JOIN card_views v ON w.card_id = v.card_id""",
)
def watchlist_cards(f):
    rows = serving.watchlist_cards(f.watchlist, card_views(f))
    return rows.select("user_id", "created_at", "card_id", "name", "set_name")


@query(
    "watchlist_alerts",
    "alerts watchlist",
    f"SELECT {_ALERT} FROM alerts WHERE card_id IN (SELECT card_id FROM watchlist)",
)
def watchlist_alerts(f):
    return serving.watchlist_alerts(_named(f), f.watchlist).select(*_ALERT_COLUMNS)


@query(
    "watchlist_fanout",
    "alerts watchlist",
    """SELECT w.user_id, a.event_id, a.type, a.card_id FROM alerts a
       JOIN watchlist w ON a.card_id = w.card_id""",
)
def watchlist_fanout(f):
    rows = serving.watchlist_fanout(_alerts(f), f.watchlist)
    return rows.select("user_id", "event_id", "type", "card_id")


@query(
    "watchlist_mutations",
    "watchlist cards",
    """SELECT user_id, card_id, 'kept' AS state FROM watchlist
       WHERE card_id IN (SELECT card_id FROM cards)
       UNION ALL SELECT DISTINCT 'everyone', card_id, 'added' FROM watchlist""",
)
def watchlist_mutations(f):
    """Drop entries of uncatalogued cards, then add every watched card for a common user."""
    keys = ["user_id", "card_id"]
    stored = f.watchlist.select(*keys, F.lit("kept").alias("state"))
    gone = stored.join(catalogue(f).cards, "card_id", "left_anti")
    left = merge.delete_keys(stored, gone, keys)
    again = stored.join(catalogue(f).cards, "card_id", "left_semi")
    common = stored.withColumn("user_id", F.lit("everyone"))
    added = again.unionByName(common).withColumn("state", F.lit("added"))
    return merge.insert_if_absent(left, added, keys)
