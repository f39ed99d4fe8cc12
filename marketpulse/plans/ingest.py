"""Raw feeds to clean tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.keys import market_key
from marketpulse.operators import normalize, quality
from marketpulse.schemas import LISTING, SALE, ValidationLimits

# A listing and a sale share one id space per source, and listings are taken in first; then
# the first delivery counts. The rest makes the order unique where arrivals are not told.
DELIVERY_ORDER = [
    "feed_rank", "arrival", "ts", "price_raw", "quantity", "seller_id", "card_id", "finish",
    "condition",
]


@dataclass(frozen=True)
class Ingested:
    """Everything one ingest run yields; all lazy."""

    polled: DataFrame
    checked: DataFrame
    drops: DataFrame

    @property
    def quarantine(self) -> DataFrame:
        return quality.quarantine(self.checked)

    @property
    def sales(self) -> DataFrame:
        return self._clean("sale", "sold_at", SALE.names)

    @property
    def listings(self) -> DataFrame:
        return self._clean("listing", "listed_at", LISTING.names)

    def status(self, as_of: Column) -> DataFrame:
        return quality.ingestion_status(self.polled, self.checked, as_of)

    def cursors(self, as_of: Column) -> DataFrame:
        return quality.source_cursor(self.polled, as_of)

    def _clean(self, feed: str, ts: str, columns: list[str]) -> DataFrame:
        rows = quality.accepted(self.checked.filter(F.col("feed") == feed))
        priced = normalize.with_price(rows.withColumn(ts, F.col("ts")))
        return priced.select(*columns).withColumn("market_key", market_key())


def as_feed(normalized: DataFrame, feed: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Normalised listings or sales in the common layout of the ingest run.

    ``arrival`` tells the order of deliveries within a feed; a feed that has none gets null.
    """
    ts = "listed_at" if feed == "listing" else "sold_at"
    seller = F.col("seller_id") if feed == "listing" else F.lit(None).cast("string")
    return normalized.select(
        "event_id", "source", "card_id", "finish", "condition", "price_raw", "quantity",
        seller.alias("seller_id"),
        F.col(ts).alias("ts"),
        F.lit(feed).alias("feed"),
        F.lit(0 if feed == "listing" else 1).alias("feed_rank"),
        (F.col("arrival") if "arrival" in normalized.columns else F.lit(None))
        .cast("long").alias("arrival"),
        *keep,
    )


def ingest(
    raw_listings: DataFrame,
    raw_sales: DataFrame,
    products: DataFrame,
    cards: DataFrame,
    as_of: Column,
    source: str | None = None,
    limits: ValidationLimits = ValidationLimits(),
) -> Ingested:
    """Normalise, deduplicate, then validate.

    Deduplication comes first: the id of a rejected event stays taken, so a corrected
    redelivery counts as a duplicate.
    """
    resolved = [
        (normalize.resolve(raw_listings, products, source), "listing"),
        (normalize.resolve(raw_sales, products, source), "sale"),
    ]
    parts = [
        as_feed(df.filter(F.col("drop_reason").isNull()), feed) for df, feed in resolved
    ]
    polled = parts[0].unionByName(parts[1])
    first = quality.dedup_events(polled, DELIVERY_ORDER)
    checked = quality.with_reject_reason(first, cards, as_of, "ts", limits)
    reasons = [df.select("source", "drop_reason") for df, _ in resolved]
    return Ingested(polled, checked, normalize.drop_counts(reasons[0].unionByName(reasons[1])))
