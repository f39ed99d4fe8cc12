"""Raw feed records to canonical events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions import feed, keys, money
from marketpulse.schemas import CONDITIONS, MONEY


def resolve(raw: DataFrame, products: DataFrame, source: str | None = None) -> DataFrame:
    """Canonical columns for every raw row, plus ``drop_reason`` (null = kept).

    ``products`` holds one row per product id. The join carries no broadcast hint: Spark
    broadcasts the map while it is small by its own size estimate, and past that shuffles
    and splits a hot product at run time. ``source`` None keeps the rows' own source.
    """
    tagged = raw if source is None else raw.withColumn("source", F.lit(source))
    finish = feed.finish_of(F.col("sub_type_name"))
    joined = tagged.join(products.select("product_id", "card_id"), "product_id", "left")
    reason = (
        F.when(F.col("card_id").isNull(), "unresolved_product")
        .when(F.col("finish").isNull(), "bad_subtype")
        .when(F.col("event_id").isNull(), "missing_id")
    )
    out = joined.withColumns(
        {
            "event_id": keys.namespaced_id(F.col("source"), F.col("event_id").cast("string")),
            "finish": finish,
            "condition": keys.enum_or_null(F.col("condition"), CONDITIONS),
            "quantity": F.coalesce("quantity", F.lit(0)),
        }
    ).withColumn("drop_reason", reason)
    carried = [c for c in ("seller_id", "listed_at", "sold_at", "arrival") if c in raw.columns]
    return out.select(
        "event_id", "source", "card_id", "finish", "condition", "price_raw", "quantity",
        *carried, "drop_reason",
    )


def normalize(raw: DataFrame, products: DataFrame, source: str | None = None) -> DataFrame:
    """Kept rows only. ``price`` is still text (``price_raw``) for the validator."""
    resolved = resolve(raw, products, source)
    return resolved.filter(F.col("drop_reason").isNull()).drop("drop_reason")


def with_price(events: DataFrame) -> DataFrame:
    """Replace the price text of accepted events by its DECIMAL(12,2) value."""
    price = money.price_from_text(F.col("price_raw")).cast(MONEY).alias("price")
    return events.select(*[price if c == "price_raw" else c for c in events.columns])


def drop_counts(resolved: DataFrame) -> DataFrame:
    dropped = resolved.filter(F.col("drop_reason").isNotNull())
    counts = dropped.groupBy("source", "drop_reason").agg(F.count("*").alias("dropped"))
    return counts.withColumnRenamed("drop_reason", "reason")
