"""Catalogue price rules: printings by rarity, price bands."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketpulse.schemas import FINISHES, MONEY

# Price bands around a market price.
PRICE_BANDS = {
    "low_price": Decimal("0.85"),
    "mid_price": Decimal("1"),
    "high_price": Decimal("1.30"),
    "market_price": Decimal("1"),
    "direct_low_price": Decimal("0.80"),
}


def printings(rarity: Column) -> Column:
    """Array of finishes a card is sold in."""
    name = F.coalesce(F.lower(rarity), F.lit(""))
    basic = F.array(F.lit("NORMAL"), F.lit("REVERSE_HOLOFOIL"))
    every = F.array(*[F.lit(f) for f in FINISHES])
    return F.when((F.trim(name) == "") | F.contains(name, F.lit("common")), basic).otherwise(every)


def price_bands(market_price: Column) -> list[Column]:
    return [
        F.round(market_price * F.lit(factor), 2).cast(MONEY).alias(name)
        for name, factor in PRICE_BANDS.items()
    ]
