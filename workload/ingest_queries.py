"""Feeds, normalisation, validation, deduplication."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from marketpulse.functions import feed, keys
from marketpulse.operators import catalog, late, normalize, quality
from marketpulse.plans.ingest import DELIVERY_ORDER
from marketpulse.session import shared_dir
from marketpulse.sources import feeds
from workload.checks import WINDOW_COLUMNS
from workload.registry import query
from workload.tables import as_of, catalogue, ingested, products, rounded
from workload.views import AS_OF

_RAW = "event_id, product_id, sku_id, sub_type_name, condition, price_raw, quantity"


def _written(f, lines) -> str:
    path = shared_dir(f.spark, "lines")
    lines.select("value").write.text(path)
    return path


@query(
    "raw_listing_scan",
    "raw_feed",
    f"SELECT {_RAW}, seller_id, ts AS listed_at FROM raw_feed WHERE event_type = 'view'",
)
def raw_listing_scan(f):
    return feeds.read_raw_listings(f.spark, _written(f, f.listing_lines))


@query(
    "raw_sale_scan",
    "raw_feed",
    f"SELECT {_RAW}, ts AS sold_at FROM raw_feed WHERE event_type <> 'view'",
)
def raw_sale_scan(f):
    return feeds.read_raw_sales(f.spark, _written(f, f.sale_lines))


@query(
    "corrupt_quarantine",
    "broken_lines raw_feed",
    """SELECT r.event_id, r.price_raw, NULL AS corrupt_line FROM raw_feed r
       WHERE event_type <> 'view' AND event_id % 5 <> 0
       UNION ALL SELECT NULL, NULL, value FROM broken_lines WHERE event_id % 5 = 0""",
)
def corrupt_quarantine(f):
    parsed = feeds.parse_lines(f.spark.read.text(_written(f, f.broken_lines)), "sale")
    good = feeds.readable(parsed).select("event_id", "price_raw")
    return good.unionByName(feeds.corrupt(parsed), allowMissingColumns=True)


@query(
    "incremental_since",
    "raw_feed",
    f"""SELECT event_id, ts FROM raw_feed WHERE ts > TIMESTAMP '2024-01-10 00:00:00'
        ORDER BY ts, event_id LIMIT 1000""",
)
def incremental_since(f):
    after = F.lit("2024-01-10 00:00:00").cast("timestamp")
    return feeds.since(f.raw_feed.select("event_id", "ts"), "ts", after, 1000)


@query(
    "retention_prune",
    "tick",
    """SELECT event_id, ts FROM tick
       WHERE ts >= (SELECT max(ts) FROM tick) - INTERVAL 10 DAY""",
)
def retention_prune(f):
    return feeds.retain(f.tick.select("event_id", "ts"), "ts", timedelta(days=10))


@query(
    "multi_source_union",
    "sales bulk_sales",
    """SELECT source, event_id, market_key, CAST(price AS DOUBLE) AS price, sold_at FROM sales
       UNION ALL
       SELECT source, event_id, market_key, CAST(price AS DOUBLE), sold_at FROM bulk_sales""",
)
def multi_source_union(f):
    configs = {
        "sim": {"type": "feed", "view": "sales"},
        "bulk": {"type": "feed", "view": "bulk_sales"},
        "other": {"type": "unheard-of"},
        "off": {"type": "feed", "view": "sales", "enabled": False},
    }
    columns = ["event_id", "market_key", "price", "sold_at"]
    readers = {"feed": lambda spark, config: getattr(f, config["view"]).select(*columns)}
    return feeds.union_sources(f.spark, configs, readers)


_CANON = "event_id, source, card_id, finish, condition, price_raw, quantity"


@query(
    "normalize_listings",
    "resolved_listings",
    f"SELECT {_CANON}, seller_id, listed_at FROM resolved_listings WHERE drop_reason IS NULL",
)
def normalize_listings(f):
    return normalize.normalize(f.raw_listings, products(f), "sim")


@query(
    "normalize_sales",
    "resolved_sales",
    f"SELECT {_CANON}, sold_at FROM resolved_sales WHERE drop_reason IS NULL",
)
def normalize_sales(f):
    return normalize.normalize(f.raw_sales, products(f), "sim")


@query(
    "normalize_drop_counts",
    "resolved_sales resolved_listings",
    """SELECT source, drop_reason AS reason, count(*) AS dropped
       FROM (SELECT source, drop_reason FROM resolved_sales
             UNION ALL SELECT source, drop_reason FROM resolved_listings) r
       WHERE drop_reason IS NOT NULL GROUP BY source, drop_reason""",
)
def normalize_drop_counts(f):
    return ingested(f).drops


@query(
    "finish_mapping",
    "raw_feed",
    """SELECT sub_type_name, CASE trim(lower(sub_type_name)) WHEN 'normal' THEN 'NORMAL'
              WHEN 'holofoil' THEN 'HOLOFOIL' WHEN 'reverse holofoil' THEN 'REVERSE_HOLOFOIL' END
              AS finish, count(*) AS events
       FROM raw_feed GROUP BY 1, 2""",
)
def finish_mapping(f):
    finish = feed.finish_of(F.col("sub_type_name")).alias("finish")
    return f.raw_feed.groupBy("sub_type_name", finish).agg(F.count("*").alias("events"))


@query(
    "market_key_build",
    "dirty_sales",
    """SELECT event_id, card_id || '|' || finish || '|' || condition AS market_key
       FROM dirty_sales""",
)
def market_key_build(f):
    return f.dirty_sales.select("event_id", keys.market_key().alias("market_key"))


@query(
    "market_key_parse",
    "tick",
    """SELECT event_id, text, CASE WHEN valid THEN split_part(text, '|', 1) END AS card_id,
              CASE WHEN valid THEN split_part(text, '|', 2) END AS finish,
              CASE WHEN valid THEN split_part(text, '|', 3) END AS condition, valid
       FROM (SELECT *, coalesce(len(string_split(text, '|')) = 3
                    AND split_part(text, '|', 2) IN ('NORMAL', 'HOLOFOIL', 'REVERSE_HOLOFOIL')
                    AND split_part(text, '|', 3) IN ('NM', 'LP', 'MP', 'HP', 'DMG'), false)
                    AS valid
             FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN card_id || '|' || finish
                          WHEN 1 THEN card_id || '|' || lower(finish) || '|' || condition
                          WHEN 2 THEN card_id || '|' || finish || '|' || condition || '|x'
                          WHEN 3 THEN NULL
                          ELSE card_id || '|' || finish || '|' || condition END AS text
                   FROM tick) a) b""",
)
def market_key_parse(f):
    text = F.expr(
        """CASE event_id % 6 WHEN 0 THEN concat(card_id, '|', finish)
           WHEN 1 THEN concat(card_id, '|', lower(finish), '|', condition)
           WHEN 2 THEN concat(card_id, '|', finish, '|', condition, '|x')
           WHEN 3 THEN NULL ELSE concat(card_id, '|', finish, '|', condition) END"""
    )
    asked = f.tick.select("event_id", text.alias("text"))
    return asked.select("event_id", "text", keys.parse_market_key(F.col("text")).alias("k")).select(
        "event_id", "text", "k.*"
    )


@query(
    "event_time",
    "tick",
    """SELECT event_id, coalesce(event_ts, CASE WHEN record_ts >= TIMESTAMP '1970-01-01' THEN
              record_ts END, greatest(partition_ts, TIMESTAMP '1970-01-01'),
              TIMESTAMP '1970-01-01') AS event_time
       FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts END AS event_ts,
                    CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL 30000 DAY
                         ELSE ts + INTERVAL 1 HOUR END AS record_ts,
                    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1
                         THEN ts - INTERVAL 30000 DAY ELSE ts END AS partition_ts
             FROM tick) t""",
)
def event_time(f):
    rows = f.tick.selectExpr(
        "event_id",
        "CASE WHEN event_id % 3 = 0 THEN ts END AS event_ts",
        "CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL 30000 DAY ELSE ts + INTERVAL 1 HOUR END"
        " AS record_ts",
        "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN ts - INTERVAL 30000 DAY"
        " ELSE ts END AS partition_ts",
    )
    time = feed.event_time(F.col("event_ts"), F.col("record_ts"), F.col("partition_ts"))
    return rows.select("event_id", time.alias("event_time"))


@query(
    "validate_sales",
    "checked_sales",
    "SELECT event_id, card_id, price_raw, reject_reason FROM checked_sales",
)
def validate_sales(f):
    checked = quality.with_reject_reason(f.dirty_sales, catalogue(f).cards, as_of(), "sold_at")
    return checked.select("event_id", "card_id", "price_raw", "reject_reason")


@query(
    "validate_listings",
    "checked_listings",
    "SELECT event_id, card_id, seller_id, reject_reason FROM checked_listings",
)
def validate_listings(f):
    cards = catalogue(f).cards
    checked = quality.with_reject_reason(f.dirty_listings, cards, as_of(), "listed_at")
    return checked.select("event_id", "card_id", "seller_id", "reject_reason")


@query(
    "reject_counts",
    "checked_sales checked_listings",
    """SELECT source, reject_reason AS reason, count(*) AS rejected
       FROM (SELECT source, reject_reason FROM checked_sales
             UNION ALL SELECT source, reject_reason FROM checked_listings) c
       WHERE reject_reason IS NOT NULL GROUP BY source, reject_reason""",
)
def reject_counts(f):
    cards = catalogue(f).cards
    sales = quality.with_reject_reason(f.dirty_sales, cards, as_of(), "sold_at")
    listings = quality.with_reject_reason(f.dirty_listings, cards, as_of(), "listed_at")
    columns = ["source", "reject_reason"]
    return quality.reject_counts(sales.select(*columns).unionByName(listings.select(*columns)))


@query(
    "quarantine",
    "judged",
    """SELECT event_id, source, feed, card_id, price_raw, quantity, seller_id, ts, reject_reason
       FROM judged WHERE reject_reason IS NOT NULL""",
)
def quarantine(f):
    return ingested(f).quarantine.select(
        "event_id", "source", "feed", "card_id", "price_raw", "quantity", "seller_id", "ts",
        "reject_reason",
    )


@query(
    "clean_sales",
    "judged",
    """SELECT event_id, source, card_id, finish, condition, CAST(price_raw AS DOUBLE) AS price,
              quantity, ts AS sold_at, card_id || '|' || finish || '|' || condition AS market_key
       FROM judged WHERE reject_reason IS NULL AND feed = 'sale'""",
)
def clean_sales(f):
    return ingested(f).sales


@query(
    "clean_listings",
    "judged",
    """SELECT event_id, source, card_id, finish, condition, CAST(price_raw AS DOUBLE) AS price,
              quantity, seller_id, ts AS listed_at,
              card_id || '|' || finish || '|' || condition AS market_key
       FROM judged WHERE reject_reason IS NULL AND feed = 'listing'""",
)
def clean_listings(f):
    return ingested(f).listings


@query(
    "dedup_events",
    "judged",
    "SELECT event_id, source, feed, card_id, price_raw, quantity, ts FROM judged",
)
def dedup_events(f):
    first = quality.dedup_events(ingested(f).polled, DELIVERY_ORDER)
    return first.select("event_id", "source", "feed", "card_id", "price_raw", "quantity", "ts")


@query(
    "duplicate_counts",
    "polled",
    """SELECT source, CAST(count(*) - count(DISTINCT event_id) AS BIGINT) AS duplicates
       FROM polled GROUP BY source""",
)
def duplicate_counts(f):
    return quality.duplicate_counts(ingested(f).polled)


_CURSOR = f"max(ts) FILTER (ts <= TIMESTAMP '{AS_OF}')"


@query(
    "source_cursor",
    "polled",
    f"SELECT source, feed, {_CURSOR} AS cursor FROM polled GROUP BY source, feed",
)
def source_cursor(f):
    return ingested(f).cursors(as_of())


@query(
    "ingested_counts",
    "judged",
    """SELECT source, feed AS type, count(*) AS ingested FROM judged
       WHERE reject_reason IS NULL GROUP BY source, feed""",
)
def ingested_counts(f):
    return quality.ingested_counts(quality.accepted(ingested(f).checked))


@query(
    "ingestion_status",
    "judged polled",
    f"""SELECT p.source, listings_cursor, sales_cursor, ingested, rejected,
               polled - ingested - rejected AS duplicates
        FROM (SELECT source, max(ts) FILTER (ts <= TIMESTAMP '{AS_OF}' AND feed = 'listing')
                         AS listings_cursor,
                     max(ts) FILTER (ts <= TIMESTAMP '{AS_OF}' AND feed = 'sale')
                         AS sales_cursor, count(*) AS polled
              FROM polled GROUP BY source) p
        JOIN (SELECT source, count(*) FILTER (reject_reason IS NULL) AS ingested,
                     count(*) FILTER (reject_reason IS NOT NULL) AS rejected
              FROM judged GROUP BY source) j ON p.source = j.source""",
)
def ingestion_status(f):
    return ingested(f).status(as_of())


@query(
    "allowlist_semi",
    "dirty_sales cards",
    """SELECT event_id, card_id FROM dirty_sales
       WHERE card_id IN (SELECT card_id FROM cards)""",
)
def allowlist_semi(f):
    return catalog.allowed(f.dirty_sales.select("event_id", "card_id"), catalogue(f).cards)


@query(
    "allowlist_anti",
    "dirty_sales cards",
    """SELECT event_id, card_id FROM dirty_sales
       WHERE card_id NOT IN (SELECT card_id FROM cards)""",
)
def allowlist_anti(f):
    return catalog.not_allowed(f.dirty_sales.select("event_id", "card_id"), catalogue(f).cards)


@query(
    "late_events",
    "sales",
    """SELECT event_id, sold_at, arrived_at, stream_time,
              date_trunc('hour', sold_at) + INTERVAL 1 HOUR <= stream_time AS late
       FROM (SELECT *, max(sold_at) OVER (ORDER BY arrived_at, event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stream_time
             FROM (SELECT event_id, sold_at,
                          sold_at + quantity * INTERVAL 20 MINUTE AS arrived_at FROM sales) a) b""",
)
def late_events(f):
    arrived = f.sales.select(
        "event_id",
        "sold_at",
        F.expr("sold_at + quantity * INTERVAL 20 MINUTE").alias("arrived_at"),
    )
    timed = late.with_stream_time(arrived, "arrived_at", "sold_at")
    return late.with_lateness(timed, "sold_at")


@query(
    "late_ma_24h",
    "sales",
    f"""SELECT * FROM (WITH timed AS (
          SELECT *, max(sold_at) OVER (ORDER BY arrived_at, event_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stream_time
          FROM (SELECT *, sold_at + quantity * INTERVAL 4 HOUR AS arrived_at FROM sales) a),
        hops AS (
          SELECT market_key, price, quantity, stream_time,
                 unnest(generate_series(date_trunc('hour', sold_at) - INTERVAL 23 HOUR,
                        date_trunc('hour', sold_at), INTERVAL 1 HOUR)) AS window_start
          FROM timed)
        SELECT market_key, window_start, window_start + INTERVAL 24 HOUR AS window_end,
               {WINDOW_COLUMNS}
        FROM hops WHERE window_start + INTERVAL 24 HOUR > stream_time
        GROUP BY market_key, window_start) late_windows""",
)
def late_ma_24h(f):
    """Sales come in four to sixteen hours after they were made, and miss what has closed."""
    arrived = f.sales.withColumn("arrived_at", F.expr("sold_at + quantity * INTERVAL 4 HOUR"))
    timed = late.with_stream_time(arrived, "arrived_at", "sold_at")
    rows = rounded(late.trailing_aggregates(timed))
    return rows.select(
        "market_key", "window_start", "window_end", "avg_price", "volatility", "volume",
        "sample_count",
    )
