"""Market feeds derived from the test tables.

Each view is one SELECT that Spark and DuckDB both run, so a query and its check start from
the same rows. Views take whole tables: feeds differ by event type, and defects are put in
by CASE, never by leaving rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.session import SHARED_DIR

#: "Now" for the validator; the events lie in January 2024.
AS_OF = "2024-02-01 00:00:00"
#: Sets released before this day are not in the catalogue.
CUTOFF = "2021-01-01"

_FINISH = (
    "CASE user_id % 3 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'HOLOFOIL' ELSE 'REVERSE_HOLOFOIL' END"
)
_CONDITION = (
    "CASE CAST(floor(user_id / 3) AS BIGINT) % 5 WHEN 0 THEN 'NM' WHEN 1 THEN 'LP' "
    "WHEN 2 THEN 'MP' WHEN 3 THEN 'HP' ELSE 'DMG' END"
)
_SALE_TYPES = "event_type <> 'view'"

VIEWS: dict[str, str] = {
    "tick": f"""
        SELECT event_id, event_type, ts, CAST(value AS DECIMAL(12,2)) AS price,
               CAST(floor(user_id / 3) AS BIGINT) AS card_no,
               concat('c', CAST(floor(user_id / 3) AS BIGINT)) AS card_id,
               {_FINISH} AS finish, {_CONDITION} AS condition,
               CAST(1 + event_id % 4 AS INT) AS quantity
        FROM events""",
    "sales": f"""
        SELECT concat('sim:', event_id) AS event_id, 'sim' AS source, card_id, finish, condition,
               concat(card_id, '|', finish, '|', condition) AS market_key, price, quantity,
               ts AS sold_at
        FROM tick WHERE {_SALE_TYPES}""",
    "listings": """
        SELECT concat('sim:', event_id) AS event_id, 'sim' AS source, card_id, finish, condition,
               concat(card_id, '|', finish, '|', condition) AS market_key, price, quantity,
               concat('s-', event_id % 500) AS seller_id, ts AS listed_at
        FROM tick WHERE event_type = 'view'""",
    # Raw feed rows. Some printings have a name the catalogue does not know; sellers with a
    # separator in their name and the defects of error events exercise the validator.
    "raw_feed": f"""
        SELECT event_id, event_type, 500000 + card_no AS product_id, 1000000 + card_no AS sku_id,
               CASE WHEN event_id % 17 = 0 THEN 'Foil Etched'
                    WHEN finish = 'NORMAL' THEN ' normal'
                    WHEN finish = 'HOLOFOIL' THEN 'Holofoil'
                    ELSE 'Reverse Holofoil ' END AS sub_type_name,
               CASE WHEN event_type = 'error' AND event_id % 8 = 5 THEN NULL
                    ELSE condition END AS condition,
               CASE WHEN event_type <> 'error' THEN CAST(price AS STRING)
                    WHEN event_id % 8 = 1 THEN '0.00'
                    WHEN event_id % 8 = 2 THEN '7.350'
                    WHEN event_id % 8 = 6 THEN '1000000.01'
                    ELSE CAST(price AS STRING) END AS price_raw,
               CASE WHEN event_type = 'error' AND event_id % 8 = 3 THEN 0
                    ELSE quantity END AS quantity,
               CASE WHEN event_id % 7 = 0 THEN concat('s|', event_id % 500)
                    ELSE concat('s-', event_id % 500) END AS seller_id,
               CASE WHEN event_type = 'error' AND event_id % 8 = 4
                    THEN ts + INTERVAL 400 DAY ELSE ts END AS ts
        FROM tick""",
    "raw_listings": """
        SELECT event_id, product_id, sku_id, sub_type_name, condition, price_raw, quantity,
               seller_id, ts AS listed_at
        FROM raw_feed WHERE event_type = 'view'""",
    # Purchases are delivered a second time.
    "raw_sales": """
        SELECT event_id, product_id, sku_id, sub_type_name, condition, price_raw, quantity,
               ts AS sold_at
        FROM raw_feed WHERE event_type <> 'view'
        UNION ALL
        SELECT event_id, product_id, sku_id, sub_type_name, condition, price_raw, quantity,
               ts AS sold_at
        FROM raw_feed WHERE event_type = 'purchase'""",
    # Canonical sales with one defect each, before validation.
    "dirty_sales": """
        SELECT concat('sim:', event_id) AS event_id, 'sim' AS source,
               CASE event_id % 8 WHEN 0 THEN 'nowhere-0' WHEN 6 THEN concat(card_id, '|x')
                    ELSE card_id END AS card_id,
               finish, CASE WHEN event_id % 8 = 5 THEN NULL ELSE condition END AS condition,
               CASE event_id % 8 WHEN 1 THEN '0.00' WHEN 2 THEN '7.350'
                    ELSE CAST(price AS STRING) END AS price_raw,
               CASE WHEN event_id % 8 = 3 THEN 0 ELSE quantity END AS quantity,
               CASE WHEN event_id % 8 = 4 THEN ts + INTERVAL 400 DAY ELSE ts END AS sold_at
        FROM tick""",
    "dirty_listings": """
        SELECT concat('sim:', event_id) AS event_id, 'sim' AS source,
               CASE event_id % 8 WHEN 0 THEN 'nowhere-0' ELSE card_id END AS card_id,
               finish, condition,
               CASE event_id % 8 WHEN 1 THEN '1000000.01' ELSE CAST(price AS STRING) END AS price_raw,
               quantity,
               CASE event_id % 8 WHEN 6 THEN 'two|parts' WHEN 7 THEN NULL
                    ELSE concat('s-', event_id % 500) END AS seller_id,
               CASE WHEN event_id % 8 = 4 THEN ts - INTERVAL 400 DAY ELSE ts END AS listed_at
        FROM tick""",
    "raw_sets": """
        SELECT lower(replace(p_brand, '#', '')) AS set_id, p_brand AS name,
               concat('series-', n % 4) AS series, CAST(count(*) AS INT) AS printed_total,
               CAST(count(*) + n AS INT) AS total,
               CASE WHEN n % 11 = 0 THEN NULL WHEN n = 13 THEN 'not-a-date'
                    ELSE concat(CAST(2020 + n % 7 AS STRING), '/03/22') END AS release_date_raw,
               concat('logo/', n, '.png') AS logo_url, concat('symbol/', n, '.png') AS symbol_url
        FROM (SELECT p_brand, CAST(replace(p_brand, 'Brand#', '') AS INT) AS n FROM part) b
        GROUP BY p_brand, n""",
    "raw_cards": """
        SELECT concat('c', p_partkey) AS card_id, lower(replace(p_brand, '#', '')) AS set_id,
               p_name AS name, CAST(p_size AS STRING) AS number,
               CASE p_type WHEN 'ECONOMY' THEN 'Common' WHEN 'SMALL' THEN 'Uncommon'
                    WHEN 'MEDIUM' THEN 'Rare Holo' WHEN 'LARGE' THEN 'Ultra Rare'
                    WHEN 'PROMO' THEN 'Illustration Rare'
                    ELSE 'Special Illustration Rare' END AS rarity,
               p_type AS supertype, concat('s/', p_partkey, '.png') AS image_small,
               CASE WHEN p_partkey % 4 = 0 THEN NULL
                    ELSE concat('l/', p_partkey, '.png') END AS image_large
        FROM part""",
    "watchlist": """
        SELECT concat('u', c_nationkey, '-', c_custkey % 10) AS user_id,
               concat('c', CAST(floor(c_custkey / 10) AS BIGINT)) AS card_id,
               TIMESTAMP '2024-01-01 00:00:00' + c_custkey * INTERVAL 1 SECOND AS created_at
        FROM customer""",
    # Every key appears in more than one version; the supplier number is the version.
    "metadata_updates": """
        SELECT concat('c', l_partkey) AS card_id, concat('name-', l_suppkey) AS name,
               concat('set-', l_suppkey % 20) AS set, 'POKEMON' AS game,
               l_suppkey AS version
        FROM lineitem
        GROUP BY l_partkey, l_suppkey""",
    # Bulk sales at day grain.
    "bulk_sales": """
        SELECT concat('li:', l_orderkey, ':', l_linenumber, ':', l_partkey, ':', l_suppkey, ':',
                      CAST(l_extendedprice AS DECIMAL(12,2))) AS event_id,
               'bulk' AS source, concat('c', l_partkey) AS card_id,
               CASE l_returnflag WHEN 'N' THEN 'NORMAL' WHEN 'A' THEN 'HOLOFOIL'
                    ELSE 'REVERSE_HOLOFOIL' END AS finish,
               CASE l_linestatus WHEN 'O' THEN 'NM' ELSE 'LP' END AS condition,
               concat('c', l_partkey, '|',
                      CASE l_returnflag WHEN 'N' THEN 'NORMAL' WHEN 'A' THEN 'HOLOFOIL'
                           ELSE 'REVERSE_HOLOFOIL' END,
                      '|', CASE l_linestatus WHEN 'O' THEN 'NM' ELSE 'LP' END) AS market_key,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
               CAST(l_quantity AS INT) AS quantity, l_shipdate AS sold_at
        FROM lineitem""",
    # The same lines traded per brand: few tickers, long histories.
    "brand_sales": """
        SELECT concat('li:', l_orderkey, ':', l_linenumber, ':', l_partkey, ':', l_suppkey, ':',
                      CAST(l_extendedprice AS DECIMAL(12,2))) AS event_id,
               'bulk' AS source, lower(replace(p_brand, '#', '')) AS card_id,
               CASE l_returnflag WHEN 'N' THEN 'NORMAL' WHEN 'A' THEN 'HOLOFOIL'
                    ELSE 'REVERSE_HOLOFOIL' END AS finish,
               CASE l_linestatus WHEN 'O' THEN 'NM' ELSE 'LP' END AS condition,
               concat(lower(replace(p_brand, '#', '')), '|',
                      CASE l_returnflag WHEN 'N' THEN 'NORMAL' WHEN 'A' THEN 'HOLOFOIL'
                           ELSE 'REVERSE_HOLOFOIL' END,
                      '|', CASE l_linestatus WHEN 'O' THEN 'NM' ELSE 'LP' END) AS market_key,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
               CAST(l_quantity AS INT) AS quantity, l_shipdate AS sold_at
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    # JSON lines as a feed delivers them; lines of some events are cut short.
    "listing_lines": """
        SELECT event_id,
               concat('{"eventId":', event_id, ',"productId":', product_id, ',"skuId":', sku_id,
                      ',"subTypeName":"', sub_type_name, '"', coalesce(concat(
                      ',"condition":"', condition, '"'), ''), ',"price":', price_raw,
                      ',"quantity":', quantity, ',"sellerId":"', seller_id, '","listedAt":"',
                      replace(CAST(ts AS STRING), ' ', 'T'), 'Z"}') AS value
        FROM raw_feed WHERE event_type = 'view'""",
    "sale_lines": """
        SELECT event_id,
               concat('{"eventId":', event_id, ',"productId":', product_id, ',"skuId":', sku_id,
                      ',"subTypeName":"', sub_type_name, '"', coalesce(concat(
                      ',"condition":"', condition, '"'), ''), ',"price":', price_raw,
                      ',"quantity":', quantity, ',"soldAt":"',
                      replace(CAST(ts AS STRING), ' ', 'T'), 'Z"}') AS value
        FROM raw_feed WHERE event_type <> 'view'""",
    "broken_lines": """
        SELECT event_id, CASE WHEN event_id % 5 = 0 THEN substr(value, 1, 40)
                              ELSE value END AS value
        FROM sale_lines""",
}

#: Tables and views each view reads.
READS = {
    "tick": ("events",),
    "sales": ("tick",),
    "listings": ("tick",),
    "raw_feed": ("tick",),
    "raw_listings": ("raw_feed",),
    "raw_sales": ("raw_feed",),
    "dirty_sales": ("tick",),
    "dirty_listings": ("tick",),
    "raw_sets": ("part",),
    "raw_cards": ("part",),
    "watchlist": ("customer",),
    "metadata_updates": ("lineitem",),
    "bulk_sales": ("lineitem",),
    "brand_sales": ("lineitem", "part"),
    "listing_lines": ("raw_feed",),
    "sale_lines": ("raw_feed",),
    "broken_lines": ("sale_lines",),
}


def closure(names: tuple[str, ...]) -> list[str]:
    """The views needed for ``names``, each after those it reads."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in done:
            for part in READS[name]:
                visit(part)
            done.append(name)

    for name in names:
        visit(name)
    return done


class Feeds:
    """The views as DataFrames over one folder of tables, batch or streaming."""

    def __init__(self, spark: SparkSession, sf_dir: str, streaming: bool = False):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        if not spark.conf.get(SHARED_DIR, None):
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            spark.conf.set(SHARED_DIR, f"{warehouse}/_scratch")
        self.spark, self.sf_dir, self.streaming = spark, sf_dir, streaming

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if not self.streaming:
            return self.spark.read.parquet(path)
        schema = self.spark.read.parquet(path).schema
        # A pattern, since a streaming source takes folders and patterns but no plain file.
        return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{name}.parque[t]")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        parts = {t: t for t in READS[name]}
        body = VIEWS[name]
        frames = {t: (self._raw(t) if t in VIEWS else self.table(t)) for t in parts}
        return _utc(self._run(body, frames))

    def _raw(self, name: str) -> DataFrame:
        frames = {t: (self._raw(t) if t in VIEWS else self.table(t)) for t in READS[name]}
        return self._run(VIEWS[name], frames)

    def _run(self, body: str, frames: dict[str, DataFrame]) -> DataFrame:
        for name, frame in frames.items():
            frame.createOrReplaceTempView(name)
        return self.spark.sql(body)


def _utc(df: DataFrame) -> DataFrame:
    """Zone-less parquet times as instants."""
    times = {n: F.col(n).cast("timestamp") for n, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(times) if times else df
