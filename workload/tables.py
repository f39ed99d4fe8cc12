"""Tables several queries start from."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions import money
from marketpulse.operators import catalog, stats, windows
from marketpulse.plans.catalog_load import Catalog, load_catalog
from marketpulse.plans.ingest import Ingested, ingest
from workload.views import AS_OF, CUTOFF, Feeds


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def cutoff() -> dt.date:
    return dt.date.fromisoformat(CUTOFF)


def catalogue(f: Feeds) -> Catalog:
    return load_catalog(f.raw_sets, f.raw_cards, cutoff())


def card_views(f: Feeds) -> DataFrame:
    loaded = catalogue(f)
    return catalog.card_view(loaded.cards, loaded.sets)


def products(f: Feeds) -> DataFrame:
    cards = catalogue(f).cards
    number = F.expr("CAST(substr(card_id, 2) AS BIGINT)") + 500_000
    return cards.select(number.alias("product_id"), "card_id")


def ingested(f: Feeds) -> Ingested:
    return ingest(
        f.raw_listings, f.raw_sales, products(f), catalogue(f).cards, as_of(), source="sim"
    )


def price_windows(f: Feeds) -> DataFrame:
    return windows.windowed_aggregates(f.sales)


def snapshots(f: Feeds) -> DataFrame:
    return stats.market_snapshot(f.sales)


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    return df.withColumns({n: money.half_up(F.col(n), digits) for n in names or ("volatility",)})
