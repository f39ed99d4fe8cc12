"""SQL building blocks of the checks, written against the same views for DuckDB.

They restate what an operator should return, on integer cents so that sums, means and
comparisons are exact.
"""

from __future__ import annotations

from workload.views import AS_OF, CUTOFF, VIEWS, closure

CENTS = "CAST(price * 100 AS HUGEINT)"


def half_up(numerator: str, denominator: str, digits: int) -> str:
    """numerator / denominator rounded half-up to ``digits``, for values not below zero."""
    scaled = f"CAST({numerator} AS HUGEINT) * {10 ** digits}"
    return (
        f"CAST((2 * {scaled} + {denominator}) // (2 * {denominator}) AS DOUBLE) / {10 ** digits}.0"
    )


# Columns of a price window over rows with a price and a quantity.
WINDOW_COLUMNS = f"""
    CAST((2 * sum({CENTS}) + count(*)) // (2 * count(*)) AS DOUBLE) / 100.0 AS avg_price,
    round(sqrt(CAST(count(*) * sum({CENTS} * {CENTS}) - sum({CENTS}) * sum({CENTS}) AS DOUBLE)
               / 10000.0) / count(*), 6) AS volatility,
    CAST(sum(greatest(quantity, 0)) AS BIGINT) AS volume, count(*) AS sample_count"""

_HOP_STARTS = """unnest(generate_series(date_trunc('hour', sold_at) - INTERVAL 23 HOUR,
                                          date_trunc('hour', sold_at), INTERVAL 1 HOUR))"""


def windows_sql(sales: str, kind: str) -> str:
    start, length = {
        "HOURLY": ("date_trunc('hour', sold_at)", "INTERVAL 1 HOUR"),
        "DAILY": ("CAST(date_trunc('day', sold_at) AS TIMESTAMP)", "INTERVAL 1 DAY"),
        "MA_24H": (_HOP_STARTS, "INTERVAL 24 HOUR"),
    }[kind]
    return f"""
        SELECT market_key, split_part(market_key, '|', 1) AS card_id, '{kind}' AS window_type,
               window_start, window_start + {length} AS window_end, {WINDOW_COLUMNS}
        FROM (SELECT market_key, price, quantity, {start} AS window_start FROM {sales}) w
        GROUP BY market_key, window_start"""


def finish_sql(col: str) -> str:
    return f"""CASE lower(trim({col})) WHEN 'normal' THEN 'NORMAL' WHEN 'holofoil' THEN 'HOLOFOIL'
               WHEN 'reverse holofoil' THEN 'REVERSE_HOLOFOIL' END"""


def reject_sql(ts: str, seller: str | None = None) -> str:
    """First failed rule, in the order of evaluation."""
    bad = (
        "{0} IS NULL OR trim({0}) = '' OR contains({0}, '|') "
        "OR regexp_matches({0}, '[\\x00-\\x1F\\x7F-\\x{{9F}}]')"
    )
    price = "TRY_CAST(price_raw AS DECIMAL(30,10))"
    seller_rule = f"WHEN {seller} THEN 'bad_identifier'" if seller else ""
    return f"""CASE
        WHEN finish IS NULL OR condition IS NULL THEN 'missing_enum'
        WHEN {bad.format("card_id")} THEN 'bad_identifier'
        WHEN card_id NOT IN (SELECT card_id FROM cards) THEN 'unknown_card'
        WHEN {price} IS NULL OR {price} <= 0 OR {price} < 0.01 OR {price} > 1000000
             OR length(regexp_extract(price_raw, '\\.(\\d+)', 1)) > 2 THEN 'price_out_of_bounds'
        WHEN quantity < 1 OR quantity > 10000 THEN 'quantity_out_of_bounds'
        WHEN {ts} IS NULL OR {ts} > TIMESTAMP '{AS_OF}' + INTERVAL 5 MINUTE
             OR {ts} < TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY THEN 'timestamp_out_of_window'
        {seller_rule} END"""


BAD_SELLER = "seller_id IS NULL OR trim(seller_id) = '' OR contains(seller_id, '|')"


def _resolved(raw: str, carried: str) -> str:
    return f"""
        SELECT concat('sim:', r.event_id) AS event_id, 'sim' AS source, p.card_id,
               {finish_sql("sub_type_name")} AS finish,
               CASE WHEN condition IN ('NM', 'LP', 'MP', 'HP', 'DMG') THEN condition END
                   AS condition,
               price_raw, quantity, {carried},
               CASE WHEN p.card_id IS NULL THEN 'unresolved_product'
                    WHEN {finish_sql("sub_type_name")} IS NULL THEN 'bad_subtype' END
                   AS drop_reason
        FROM {raw} r LEFT JOIN products p ON r.product_id = p.product_id"""


# Sums over the sales of a ticker before each event; sales come before listings at equal
# times and then the event id decides.
_BEFORE = "OVER (PARTITION BY market_key ORDER BY ts, kind_rank, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

_SPREAD = "(n * s2 - s1 * s1)"
_GAP = "(n * c - s1)"


CHECK_VIEWS: dict[str, tuple[str, str]] = {
    "sets": (
        "raw_sets",
        f"""SELECT set_id, name, series, printed_total, total, logo_url, symbol_url,
                   CAST(try_strptime(release_date_raw, '%Y/%m/%d') AS DATE) AS release_date
            FROM raw_sets
            WHERE CAST(try_strptime(release_date_raw, '%Y/%m/%d') AS DATE) >= DATE '{CUTOFF}'""",
    ),
    "cards": (
        "raw_cards sets",
        """SELECT *, 'POKEMON' AS game FROM raw_cards
           WHERE set_id IN (SELECT set_id FROM sets)""",
    ),
    "card_views": (
        "cards sets",
        """SELECT c.card_id, c.name, c.number, c.rarity, c.supertype, c.game, c.set_id,
                  s.name AS set_name, c.image_small, c.image_large
           FROM cards c JOIN sets s ON c.set_id = s.set_id""",
    ),
    "products": (
        "cards",
        """SELECT 500000 + CAST(substr(card_id, 2) AS BIGINT) AS product_id, card_id
           FROM cards""",
    ),
    "resolved_sales": ("raw_sales products", _resolved("raw_sales", "sold_at")),
    "resolved_listings": (
        "raw_listings products",
        _resolved("raw_listings", "seller_id, listed_at"),
    ),
    "polled": (
        "resolved_sales resolved_listings",
        """SELECT event_id, source, card_id, finish, condition, price_raw, quantity, seller_id,
                  listed_at AS ts, 'listing' AS feed, 0 AS feed_rank
           FROM resolved_listings WHERE drop_reason IS NULL
           UNION ALL
           SELECT event_id, source, card_id, finish, condition, price_raw, quantity, NULL,
                  sold_at, 'sale', 1
           FROM resolved_sales WHERE drop_reason IS NULL""",
    ),
    "judged": (
        "polled cards",
        f"""SELECT *, {reject_sql("ts", f"feed = 'listing' AND ({BAD_SELLER})")} AS reject_reason
            FROM (SELECT *, row_number() OVER (PARTITION BY source, event_id
                                               ORDER BY feed_rank, ts, price_raw) AS copy
                  FROM polled) p
            WHERE copy = 1""",
    ),
    "checked_sales": (
        "dirty_sales cards",
        f"SELECT *, {reject_sql('sold_at')} AS reject_reason FROM dirty_sales",
    ),
    "checked_listings": (
        "dirty_listings cards",
        f"""SELECT *, {reject_sql("listed_at", BAD_SELLER)} AS reject_reason
            FROM dirty_listings""",
    ),
    "hourly": ("sales", windows_sql("sales", "HOURLY")),
    "daily": ("sales", windows_sql("sales", "DAILY")),
    "ma_24h": ("sales", windows_sql("sales", "MA_24H")),
    "price_windows": (
        "hourly daily ma_24h",
        "SELECT * FROM hourly UNION ALL SELECT * FROM daily UNION ALL SELECT * FROM ma_24h",
    ),
    "settled_windows": (
        "price_windows sales",
        "SELECT * FROM price_windows WHERE window_end <= (SELECT max(sold_at) FROM sales)",
    ),
    "market_events": (
        "sales listings",
        f"""SELECT event_id, source, market_key, card_id, finish, condition, price, seller_id, ts,
                   kind, c,
                   count(*) FILTER (kind_rank = 0) {_BEFORE} AS n,
                   coalesce(sum(c) FILTER (kind_rank = 0) {_BEFORE}, 0) AS s1,
                   coalesce(sum(c * c) FILTER (kind_rank = 0) {_BEFORE}, 0) AS s2
            FROM (SELECT event_id, source, market_key, card_id, finish, condition, price,
                         NULL AS seller_id, sold_at AS ts, 'sale' AS kind, 0 AS kind_rank,
                         {CENTS} AS c FROM sales
                  UNION ALL
                  SELECT event_id, source, market_key, card_id, finish, condition, price,
                         seller_id, listed_at, 'listing', 1, {CENTS} FROM listings) e""",
    ),
    "flags": (
        "market_events",
        f"""SELECT event_id, market_key, card_id, finish, condition, source, seller_id,
                   CAST(price AS DOUBLE) AS listing_price,
                   {half_up("s1", "(n * 100)", 2)} AS reference_avg,
                   {half_up("(s1 - c * n)", "s1", 4)} AS discount_pct,
                   n AS sample_count, ts AS detected_at
            FROM market_events
            WHERE kind = 'listing' AND n >= 20 AND s1 > 0 AND c * n * 100 < s1 * 85""",
    ),
    "spikes": (
        "market_events",
        f"""SELECT event_id, market_key, card_id, ts, CAST(price AS DOUBLE) AS price,
                   {half_up("s1", "(n * 100)", 4)} AS mean,
                   round(sqrt(CAST({_SPREAD} AS DOUBLE) / 10000.0) / n, 4) AS stddev,
                   round(abs(CAST({_GAP} AS DOUBLE) / 100.0)
                         / sqrt(CAST({_SPREAD} AS DOUBLE) / 10000.0), 4)
                       AS sigma,
                   n AS sample_count,
                   CASE WHEN {_GAP} * {_GAP} >= 25 * {_SPREAD} THEN 'HIGH'
                        WHEN {_GAP} * {_GAP} >= 16 * {_SPREAD} THEN 'MED' ELSE 'LOW' END
                       AS severity
            FROM market_events
            WHERE kind = 'sale' AND n >= 20 AND {_SPREAD} > 0
                  AND {_GAP} * {_GAP} > 9 * {_SPREAD}""",
    ),
    "alerts": (
        "flags spikes cards",
        """SELECT a.*, c.name
           FROM (SELECT event_id, 'SPIKE' AS type, severity, card_id, market_key, ts FROM spikes
                 UNION ALL
                 SELECT event_id, 'ARBITRAGE',
                        CASE WHEN discount_pct >= 0.40 THEN 'HIGH'
                             WHEN discount_pct >= 0.25 THEN 'MED' ELSE 'LOW' END,
                        card_id, market_key, detected_at FROM flags) a
           LEFT JOIN cards c ON a.card_id = c.card_id""",
    ),
    "snapshot": (
        "sales",
        f"""SELECT market_key, split_part(market_key, '|', 1) AS card_id,
                   split_part(market_key, '|', 2) AS finish,
                   split_part(market_key, '|', 3) AS condition,
                   CAST(arg_max(price, (sold_at, price)) AS DOUBLE) AS last_price,
                   max(sold_at) AS last_trade_at, {WINDOW_COLUMNS}
            FROM sales GROUP BY market_key""",
    ),
    "skus": (
        "cards",
        """SELECT card_id, rarity, finish, condition
           FROM (SELECT card_id, rarity, unnest(
                     CASE WHEN trim(coalesce(rarity, '')) = ''
                               OR contains(lower(rarity), 'common')
                          THEN ['NORMAL', 'REVERSE_HOLOFOIL']
                          ELSE ['NORMAL', 'HOLOFOIL', 'REVERSE_HOLOFOIL'] END) AS finish
                 FROM cards) f,
                (SELECT unnest(['NM', 'LP', 'MP', 'HP', 'DMG']) AS condition) g""",
    ),
}


def with_views(names: tuple[str, ...], body: str) -> str:
    """``body`` behind the common table expressions it needs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in CHECK_VIEWS:
            for part in CHECK_VIEWS[name][0].split():
                visit(part)
            if name not in ordered:
                ordered.append(name)
        else:
            for view in closure((name,)):
                if view not in ordered:
                    ordered.append(view)

    for name in names:
        visit(name)
    if not ordered:
        return body
    text = {n: CHECK_VIEWS[n][1] if n in CHECK_VIEWS else VIEWS[n] for n in ordered}
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in text.items()) + "\n" + body


