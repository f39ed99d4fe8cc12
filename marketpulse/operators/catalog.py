"""Catalogue loading, search, and the printing universe derived from it."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions import feed, keys, money, pricing
from marketpulse.operators.merge import first_per_key
from marketpulse.operators.numbering import consecutive_ids
from marketpulse.schemas import CONDITIONS, FINISHES, GAMES

# First surrogate ids.
FIRST_PRODUCT_ID = 500_000
FIRST_SKU_ID = 1_000_000

CARD_VIEW = [
    "card_id", "name", "number", "rarity", "supertype", "game", "set_id", "set_name",
    "image_small", "image_large",
]


def with_release_date(raw_sets: DataFrame) -> DataFrame:
    return raw_sets.withColumn("release_date", feed.release_date(F.col("release_date_raw")))


def recent_sets(raw_sets: DataFrame, cutoff: dt.date) -> DataFrame:
    """Sets released on or after ``cutoff``; a set without a usable date is left out."""
    dated = with_release_date(raw_sets).drop("release_date_raw")
    return dated.filter(F.col("release_date") >= F.lit(cutoff))


def recent_cards(raw_cards: DataFrame, kept_sets: DataFrame, game: str = "POKEMON") -> DataFrame:
    kept = raw_cards.join(kept_sets.select("set_id"), "set_id", "left_semi")
    return kept.withColumn("game", F.lit(game))


def card_metadata(cards: DataFrame, sets: DataFrame) -> DataFrame:
    """Metadata published per card; the large image is preferred."""
    named = cards.join(sets.select("set_id", F.col("name").alias("set")), "set_id")
    image = F.coalesce("image_large", "image_small").alias("image_url")
    return named.select("card_id", "name", "set", "rarity", "game", image)


def load_summary(cards: DataFrame, sets: DataFrame, cutoff: dt.date) -> DataFrame:
    totals = sets.agg(F.count("*").alias("sets"))
    card_total = cards.agg(F.count("*")).scalar()
    return totals.select(
        "sets", card_total.alias("cards"), F.lit(cutoff).alias("since_release_date")
    )


def card_view(cards: DataFrame, sets: DataFrame) -> DataFrame:
    joined = cards.join(sets.select("set_id", F.col("name").alias("set_name")), "set_id")
    return joined.select(*CARD_VIEW)


def search_filter(
    game: str | None = None,
    set_id: str | None = None,
    rarity: str | None = None,
    q: str | None = None,
) -> Column:
    """All given conditions; a blank one counts as absent.

    ``q`` is a LIKE fragment: its ``%`` and ``_`` stay wildcards.
    """
    conditions = [F.lit(True)]
    if game is not None:
        if game not in GAMES:
            raise ValueError(f"unknown game: {game}")
        conditions.append(F.col("game") == game)
    if set_id and set_id.strip():
        conditions.append(F.lower("set_id") == set_id.lower())
    if rarity and rarity.strip():
        conditions.append(F.lower("rarity") == rarity.lower())
    if q and q.strip():
        conditions.append(F.lower("name").like(f"%{q.lower()}%"))
    return reduce(lambda a, b: a & b, conditions)


def search(cards: DataFrame, sets: DataFrame, **filters: str | None) -> DataFrame:
    return card_view(cards.filter(search_filter(**filters)), sets)


def search_count(cards: DataFrame, **filters: str | None) -> DataFrame:
    return cards.filter(search_filter(**filters)).agg(F.count("*").alias("total"))


def clamp_page(page: int, page_size: int) -> tuple[int, int]:
    """Page from 0; size 50 when not positive, at most 200."""
    size = 50 if page_size <= 0 else min(page_size, 200)
    return max(page, 0), size


def card_page(
    cards: DataFrame, sets: DataFrame, page: int = 0, page_size: int = 50, **filters: str | None
) -> DataFrame:
    """One page of the matches. More than 200 rows a page are not given (see ``clamp_page``)."""
    page, size = clamp_page(page, page_size)
    ordered = search(cards, sets, **filters).orderBy("set_id", "number", "card_id")
    return ordered.offset(page * size).limit(size)


def card_by_id(cards: DataFrame, sets: DataFrame, card_id: str) -> DataFrame:
    return card_view(cards.filter(F.col("card_id") == card_id), sets)


def cards_by_id(cards: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Look up every card id of ``wanted``; an unknown id yields no row."""
    ids = wanted.select("card_id").distinct()
    return card_view(cards.join(ids, "card_id", "left_semi"), sets)


def allowed(events: DataFrame, cards: DataFrame) -> DataFrame:
    return events.join(cards.select("card_id"), "card_id", "left_semi").select(*events.columns)


def not_allowed(events: DataFrame, cards: DataFrame) -> DataFrame:
    return events.join(cards.select("card_id"), "card_id", "left_anti").select(*events.columns)


def distinct_cards(cards: DataFrame, order: list[str]) -> DataFrame:
    """First row per card id; rows without an id are skipped."""
    return first_per_key(cards.filter(F.col("card_id").isNotNull()), ["card_id"], order)


def sku_universe(cards: DataFrame, conditions: tuple[str, ...] = CONDITIONS) -> DataFrame:
    """Every (card, finish, condition) a card is sold in."""
    per_finish = cards.select(
        "card_id", "rarity", F.explode(pricing.printings(F.col("rarity"))).alias("finish")
    )
    grades = F.array(*[F.lit(c) for c in conditions])
    rows = per_finish.withColumn("condition", F.explode(grades))
    return rows.select("card_id", "rarity", "finish", "condition")


def with_base_price(skus: DataFrame, sales: DataFrame, cards: DataFrame) -> DataFrame:
    """Mean traded price of an SKU's rarity, finish and condition; null where none traded."""
    kind = ["rarity", "finish", "condition"]
    traded = sales.join(cards.select("card_id", "rarity"), "card_id").groupBy(*kind)
    sums = traded.agg(F.sum("price").alias("_sum"), F.count("price").alias("_n"))
    mean = money.mean_price(F.col("_sum"), F.col("_n")).alias("base_price")
    return skus.join(sums.select(*kind, mean), kind, "left")


def with_price_bands(snapshots: DataFrame, price: str = "avg_price") -> DataFrame:
    return snapshots.select("market_key", "card_id", *pricing.price_bands(F.col(price)))


def product_ids(cards: DataFrame) -> DataFrame:
    """Consecutive product ids in card-id order."""
    ids = cards.select("card_id").filter(F.col("card_id").isNotNull()).distinct()
    return consecutive_ids(ids, ["card_id"], "product_id", FIRST_PRODUCT_ID)


def sku_ids(skus: DataFrame) -> DataFrame:
    """Consecutive SKU ids in order of card, finish and condition."""
    ranked = skus.withColumns(
        {
            "_finish": keys.ordinal(F.col("finish"), FINISHES),
            "_condition": keys.ordinal(F.col("condition"), CONDITIONS),
        }
    )
    order = ["card_id", "_finish", "_condition"]
    return consecutive_ids(ranked, order, "sku_id", FIRST_SKU_ID).drop("_finish", "_condition")
