"""Catalogue pages and the product map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.operators.merge import last_per_key
from marketpulse.schemas import CARD_PAGE, PRODUCT_PAGE, SET_PAGE


def read_product_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRODUCT_PAGE).json(path)


def product_map(pages: DataFrame) -> DataFrame:
    """One card per product; a later page, then a later position, wins."""
    items = pages.select("page", F.posexplode("items").alias("position", "item"))
    rows = items.select(
        F.col("item.productId").alias("product_id"),
        F.col("item.cardId").alias("card_id"),
        "page",
        "position",
    )
    latest = last_per_key(rows, ["product_id"], ["page", "position"])
    return latest.select("product_id", "card_id")


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    pages = spark.read.schema(SET_PAGE).json(path)
    item = pages.select(F.explode("data").alias("s"))
    return item.select(
        F.col("s.id").alias("set_id"),
        F.col("s.name").alias("name"),
        F.col("s.series").alias("series"),
        F.col("s.printedTotal").alias("printed_total"),
        F.col("s.total").alias("total"),
        F.col("s.releaseDate").alias("release_date_raw"),
        F.col("s.images.logo").alias("logo_url"),
        F.col("s.images.symbol").alias("symbol_url"),
    )


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    pages = spark.read.schema(CARD_PAGE).json(path)
    item = pages.select(F.col("setId").alias("set_id"), F.explode("data").alias("c"))
    return item.select(
        F.col("c.id").alias("card_id"),
        "set_id",
        F.col("c.name").alias("name"),
        F.col("c.number").alias("number"),
        F.col("c.rarity").alias("rarity"),
        F.col("c.supertype").alias("supertype"),
        F.col("c.images.small").alias("image_small"),
        F.col("c.images.large").alias("image_large"),
    )


def latest_metadata(updates: DataFrame, version: str = "version") -> DataFrame:
    """Newest metadata row per card, as a compacted topic keeps it."""
    return last_per_key(updates, ["card_id"], [version]).drop(version)
