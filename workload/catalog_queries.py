"""Catalogue pages, loading, search, printings and prices."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from marketpulse.functions import feed
from marketpulse.operators import catalog
from marketpulse.plans.catalog_load import read_catalog, write_catalog
from marketpulse.session import shared_dir
from marketpulse.sources import catalog as pages
from marketpulse.sources.pages import Pages, write_pages
from workload.checks import CENTS, half_up
from workload.registry import query
from workload.tables import card_views, catalogue, cutoff, snapshots
from workload.views import CUTOFF

_VIEW = (
    "card_id, name, number, rarity, supertype, game, set_id, set_name, image_small, image_large"
)


@query(
    "product_map",
    "raw_cards",
    """SELECT 500000 + CAST(substr(card_id, 2) AS BIGINT) AS product_id, card_id
       FROM raw_cards""",
)
def product_map(f):
    """Two page runs; the later one corrects the ids of the first."""
    item = F.struct(
        (F.expr("CAST(substr(card_id, 2) AS BIGINT)") + 500_000).alias("productId"),
        F.col("card_id").alias("cardId"),
    )
    old = F.struct(item["productId"].alias("productId"), F.lit("old").alias("cardId"))
    path = shared_dir(f.spark, "products")
    stale = f.raw_cards.select(F.array(old).alias("items"), F.lit(0).alias("page"))
    fresh = f.raw_cards.select(F.array(item).alias("items"), F.lit(1).alias("page"))
    stale.unionByName(fresh).write.json(path)
    return pages.product_map(pages.read_product_pages(f.spark, path))


@query(
    "catalog_scan",
    "raw_cards raw_sets",
    """SELECT c.card_id, c.set_id, c.name, c.number, c.rarity, c.image_small, c.image_large,
              s.name AS set_name, s.series, s.release_date_raw, s.printed_total, s.logo_url
       FROM raw_cards c JOIN raw_sets s ON c.set_id = s.set_id""",
)
def catalog_scan(f):
    card = F.struct(
        F.col("card_id").alias("id"), "name", "number", "rarity", "supertype",
        F.array("supertype").alias("types"),
        F.struct(F.col("image_small").alias("small"), F.col("image_large").alias("large"))
        .alias("images"),
    )
    card_pages = f.raw_cards.select(F.col("set_id").alias("setId"), F.array(card).alias("data"))
    set_row = F.struct(
        F.col("set_id").alias("id"), "name", "series",
        F.col("printed_total").alias("printedTotal"), "total",
        F.col("release_date_raw").alias("releaseDate"),
        F.struct(F.col("symbol_url").alias("symbol"), F.col("logo_url").alias("logo"))
        .alias("images"),
    )
    set_pages = f.raw_sets.select(F.array(set_row).alias("data"))
    card_path, set_path = shared_dir(f.spark, "cards"), shared_dir(f.spark, "sets")
    card_pages.write.json(card_path)
    set_pages.write.json(set_path)
    cards = pages.read_cards(f.spark, card_path)
    sets = pages.read_sets(f.spark, set_path)
    named = sets.select(
        "set_id", F.col("name").alias("set_name"), "series", "release_date_raw", "printed_total",
        "logo_url",
    )
    return cards.drop("supertype").join(named, "set_id")


@query(
    "latest_metadata",
    "metadata_updates",
    """SELECT card_id, name, set, game FROM metadata_updates
       QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY version DESC) = 1""",
)
def latest_metadata(f):
    return pages.latest_metadata(f.metadata_updates)


@query(
    "release_date_parse",
    "raw_sets",
    """SELECT set_id, CAST(CAST(try_strptime(release_date_raw, '%Y/%m/%d') AS DATE) AS VARCHAR)
              AS release_date
       FROM raw_sets""",
)
def release_date_parse(f):
    date = feed.release_date(F.col("release_date_raw"))
    return f.raw_sets.select("set_id", date.alias("release_date"))


@query(
    "recent_sets",
    "sets",
    "SELECT set_id, name, series, total, CAST(release_date AS VARCHAR) AS release_date FROM sets",
)
def recent_sets(f):
    kept = catalog.recent_sets(f.raw_sets, cutoff())
    return kept.select("set_id", "name", "series", "total", "release_date")


@query("recent_cards", "cards", "SELECT card_id, set_id, name, rarity, game FROM cards")
def recent_cards(f):
    return catalogue(f).cards.select("card_id", "set_id", "name", "rarity", "game")


@query(
    "catalog_load_summary",
    "cards sets",
    f"""SELECT (SELECT count(*) FROM sets) AS sets, (SELECT count(*) FROM cards) AS cards,
               '{CUTOFF}' AS since_release_date""",
)
def catalog_load_summary(f):
    return catalogue(f).summary


@query(
    "card_metadata_projection",
    "cards sets",
    """SELECT c.card_id, c.name, s.name AS set, c.rarity, c.game,
              coalesce(c.image_large, c.image_small) AS image_url
       FROM cards c JOIN sets s ON c.set_id = s.set_id""",
)
def card_metadata_projection(f):
    return catalogue(f).metadata


@query("card_view", "card_views", f"SELECT {_VIEW} FROM card_views")
def card_view(f):
    return card_views(f)


@query(
    "card_search",
    "card_views",
    f"""SELECT {_VIEW} FROM card_views
        WHERE game = 'POKEMON' AND lower(rarity) = 'common' AND lower(name) LIKE '%ring%'""",
)
def card_search(f):
    loaded = catalogue(f)
    return catalog.search(
        loaded.cards, loaded.sets, game="POKEMON", set_id=" ", rarity="COMMON", q="Ring"
    )


@query(
    "card_search_count",
    "cards",
    "SELECT count(*) AS total FROM cards WHERE lower(name) LIKE '%r_d%'",
)
def card_search_count(f):
    return catalog.search_count(catalogue(f).cards, q="R_d")


@query(
    "card_page",
    "card_views",
    f"SELECT {_VIEW} FROM card_views ORDER BY set_id, number, card_id LIMIT 50 OFFSET 100",
)
def card_page(f):
    loaded = catalogue(f)
    return catalog.card_page(loaded.cards, loaded.sets, page=2, page_size=0)


_CARD_ORDER = ("set_id", "number", "card_id")


def _stored_pages(f) -> Pages:
    rows, path = card_views(f), shared_dir(f.spark, "pages")
    write_pages(rows, path, _CARD_ORDER, ranges=16)
    return Pages.open(f.spark, path, _CARD_ORDER, rows.schema)


@query(
    "card_page_stored",
    "card_views",
    f"SELECT {_VIEW} FROM card_views ORDER BY set_id, number, card_id LIMIT 50 OFFSET 100",
)
def card_page_stored(f):
    """A page of all cards from the ranges that hold it."""
    return _stored_pages(f).page(2, 50)


@query(
    "card_page_next",
    "card_views",
    f"SELECT {_VIEW} FROM card_views ORDER BY set_id, number, card_id LIMIT 50 OFFSET 50",
)
def card_page_next(f):
    """The page that follows the last row of the first one."""
    stored = _stored_pages(f)
    return stored.after(stored.token(stored.page(0, 50).collect()), 50)


@query(
    "card_by_id",
    "card_views tick",
    f"SELECT {_VIEW} FROM card_views WHERE card_id IN (SELECT card_id FROM tick)",
)
def card_by_id(f):
    loaded = catalogue(f)
    return catalog.cards_by_id(loaded.cards, loaded.sets, f.tick)


@query(
    "upsert_catalog",
    "raw_cards cards",
    """SELECT card_id, set_id, name, rarity, supertype FROM raw_cards
       WHERE card_id NOT IN (SELECT card_id FROM cards)
       UNION ALL SELECT card_id, set_id, upper(name), rarity, supertype FROM cards""",
)
def upsert_catalog(f):
    """Two loads into stored tables: every card, then the catalogue's with other names."""
    columns = ["card_id", "set_id", "name", "rarity", "supertype"]
    base, loaded = shared_dir(f.spark, "catalog"), catalogue(f)
    write_catalog(replace(loaded, cards=f.raw_cards.select(*columns)), base)
    fresh = loaded.cards.select(*columns).withColumn("name", F.upper("name"))
    write_catalog(replace(loaded, cards=fresh), base)
    return read_catalog(f.spark, base, "cards").select(*columns)


@query(
    "distinct_cards",
    "dirty_sales",
    """SELECT card_id, event_id FROM dirty_sales WHERE card_id IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY event_id) = 1""",
)
def distinct_cards(f):
    return catalog.distinct_cards(f.dirty_sales.select("card_id", "event_id"), ["event_id"])


@query("sku_universe", "skus", "SELECT card_id, rarity, finish, condition FROM skus")
def sku_universe(f):
    return catalog.sku_universe(catalogue(f).cards)


@query(
    "sku_base_price",
    "skus sales cards",
    f"""SELECT s.card_id, s.finish, s.condition, b.base_price
        FROM skus s LEFT JOIN (
          SELECT c.rarity, t.finish, t.condition,
                 {half_up(f"sum({CENTS})", "(count(*) * 100)", 2)} AS base_price
          FROM sales t JOIN cards c ON t.card_id = c.card_id GROUP BY ALL) b
        ON s.rarity = b.rarity AND s.finish = b.finish AND s.condition = b.condition""",
)
def sku_base_price(f):
    cards = catalogue(f).cards
    priced = catalog.with_base_price(catalog.sku_universe(cards), f.sales, cards)
    return priced.select("card_id", "finish", "condition", "base_price")


_AVG_CENTS = "CAST(round(avg_price * 100) AS BIGINT)"


def _band(percent: int, name: str) -> str:
    return f"{half_up(f'({_AVG_CENTS} * {percent})', '10000', 2)} AS {name}"


@query(
    "price_bands",
    "snapshot",
    f"""SELECT market_key, card_id, {_band(85, "low_price")}, avg_price AS mid_price,
               {_band(130, "high_price")}, avg_price AS market_price,
               {_band(80, "direct_low_price")}
        FROM snapshot""",
)
def price_bands(f):
    return catalog.with_price_bands(snapshots(f))


@query(
    "product_ids",
    "cards",
    "SELECT card_id, 499999 + row_number() OVER (ORDER BY card_id) AS product_id FROM cards",
)
def product_ids(f):
    return catalog.product_ids(catalogue(f).cards)


@query(
    "sku_ids",
    "skus",
    """SELECT card_id, finish, condition, 999999 + row_number() OVER (ORDER BY card_id,
              list_position(['NORMAL', 'HOLOFOIL', 'REVERSE_HOLOFOIL'], finish),
              list_position(['NM', 'LP', 'MP', 'HP', 'DMG'], condition)) AS sku_id
       FROM skus""",
)
def sku_ids(f):
    return catalog.sku_ids(catalog.sku_universe(catalogue(f).cards)).drop("rarity")
