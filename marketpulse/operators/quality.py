"""Validation, deduplication, cursors and the counters around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions import keys, money
from marketpulse.operators.merge import first_per_key
from marketpulse.schemas import CONDITIONS, FINISHES, ValidationLimits


def with_reject_reason(
    events: DataFrame,
    allowed_cards: DataFrame,
    as_of: Column,
    ts: str,
    limits: ValidationLimits = ValidationLimits(),
) -> DataFrame:
    """Add ``reject_reason``: the first failed rule, null for an accepted event.

    ``as_of`` stands for "now", so that a rerun of a batch decides alike. Where there is a
    ``seller_id``, it is checked after all common rules (in a mixed ``feed`` for listings
    only). With
    an empty catalogue every otherwise well-formed event is an ``unknown_card``.
    """
    known = allowed_cards.select("card_id").distinct().withColumn("_known", F.lit(True))
    joined = events.join(known, "card_id", "left")
    price = money.price_from_text(F.col("price_raw"))
    price_ok = (
        (price > 0)
        & (money.text_scale(F.trim("price_raw")) <= limits.max_price_scale)
        & (price >= F.lit(limits.min_price))
        & (price <= F.lit(limits.max_price))
    )
    stamp = F.col(ts)
    in_time = (stamp <= as_of + F.lit(limits.max_future_skew)) & (
        stamp >= as_of - F.lit(limits.max_age)
    )
    enums_ok = F.col("finish").isin(*FINISHES) & F.col("condition").isin(*CONDITIONS)
    rules = [
        (enums_ok, "missing_enum"),
        (keys.valid_identifier(F.col("card_id")), "bad_identifier"),
        (F.col("_known"), "unknown_card"),
        (price_ok, "price_out_of_bounds"),
        (F.col("quantity").between(1, limits.max_quantity), "quantity_out_of_bounds"),
        (in_time, "timestamp_out_of_window"),
    ]
    if "seller_id" in events.columns:
        seller_ok = keys.valid_identifier(F.col("seller_id"))
        if "feed" in events.columns:
            seller_ok = (F.col("feed") == "sale") | seller_ok
        rules.append((seller_ok, "bad_identifier"))
    reason = F.lit(None).cast("string")
    for holds, name in reversed(rules):
        reason = F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(reason)
    return joined.withColumn("reject_reason", reason).select(*events.columns, "reject_reason")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNotNull())


def dedup_events(events: DataFrame, order: list[str]) -> DataFrame:
    """First delivery of each (source, event_id)."""
    return first_per_key(events, ["source", "event_id"], order)


def duplicate_counts(events: DataFrame) -> DataFrame:
    copies = events.groupBy("source", "event_id").agg(F.count("*").alias("copies"))
    return copies.groupBy("source").agg(F.sum(F.col("copies") - 1).alias("duplicates"))


def source_cursor(
    events: DataFrame, as_of: Column, ts: str = "ts", previous: DataFrame | None = None
) -> DataFrame:
    """High-water mark per (source, feed): newest time that is not in the future.

    Every polled record counts, duplicates and rejects too. With ``previous`` (source,
    feed, cursor) a mark never moves back.
    """
    marks = events.groupBy("source", "feed").agg(
        F.max(F.when(F.col(ts) <= as_of, F.col(ts))).alias("cursor")
    )
    if previous is None:
        return marks
    both = marks.unionByName(previous.select("source", "feed", "cursor"))
    return both.groupBy("source", "feed").agg(F.max("cursor").alias("cursor"))


def ingested_counts(clean: DataFrame) -> DataFrame:
    return clean.groupBy("source", F.col("feed").alias("type")).agg(F.count("*").alias("ingested"))


def reject_counts(checked: DataFrame) -> DataFrame:
    rejected = quarantine(checked)
    counts = rejected.groupBy("source", "reject_reason").agg(F.count("*").alias("rejected"))
    return counts.withColumnRenamed("reject_reason", "reason")


def outcome_counts(checked: DataFrame) -> DataFrame:
    """Rows per source, feed and outcome: ``ingested`` or the reject reason."""
    outcome = F.coalesce("reject_reason", F.lit("ingested")).alias("outcome")
    return checked.groupBy("source", "feed", outcome).agg(F.count("*").alias("rows"))


def ingestion_status(polled: DataFrame, checked: DataFrame, as_of: Column) -> DataFrame:
    """Cursors and totals per source.

    ``polled`` holds every normalised record (source, feed, ts), ``checked`` the first
    delivery of each with its ``reject_reason``; what is missing were duplicates.
    """
    in_time = F.when(F.col("ts") <= as_of, F.col("ts"))
    seen = polled.groupBy("source").agg(
        F.max(F.when(F.col("feed") == "listing", in_time)).alias("listings_cursor"),
        F.max(F.when(F.col("feed") == "sale", in_time)).alias("sales_cursor"),
        F.count("*").alias("polled"),
    )
    bad = F.col("reject_reason").isNotNull()
    judged = checked.groupBy("source").agg(
        F.count_if(~bad).alias("ingested"), F.count_if(bad).alias("rejected")
    )
    joined = seen.join(judged, "source", "left")
    return joined.select(
        "source",
        "listings_cursor",
        "sales_cursor",
        "ingested",
        "rejected",
        (F.col("polled") - F.col("ingested") - F.col("rejected")).alias("duplicates"),
    )
