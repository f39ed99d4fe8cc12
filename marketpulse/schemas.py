"""Record layouts, enumerations and tunable limits shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
#: Running sums: exact for 1e12 rows a ticker, and as long as a ticker's price sum stays
#: below 1e17, whose square the comparisons still hold; beyond, a job fails and does not round.
PRICE_SUM = T.DecimalType(24, 2)
PRICE_SQ_SUM = T.DecimalType(34, 4)

# Enumeration members, in their declared order.
FINISHES = ("NORMAL", "HOLOFOIL", "REVERSE_HOLOFOIL")
CONDITIONS = ("NM", "LP", "MP", "HP", "DMG")
GAMES = ("POKEMON", "MTG", "ONE_PIECE")
SEVERITIES = ("LOW", "MED", "HIGH")
ALERT_TYPES = ("SPIKE", "ARBITRAGE")
WINDOW_TYPES = ("HOURLY", "DAILY", "MA_24H")


@dataclass(frozen=True)
class Thresholds:
    """When a sale is a spike and when a listing is an arbitrage chance."""

    spike_sigma: Decimal = Decimal("3")
    arbitrage_margin: Decimal = Decimal("0.15")
    min_samples: int = 20


@dataclass(frozen=True)
class ValidationLimits:
    min_price: Decimal = Decimal("0.01")
    max_price: Decimal = Decimal("1000000")
    max_price_scale: int = 2
    max_quantity: int = 10_000
    max_future_skew: timedelta = timedelta(minutes=5)
    max_age: timedelta = timedelta(days=365)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


_S, _L, _I, _D, _TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.TimestampType(),
)

SALE = _struct(
    ("event_id", _S), ("source", _S), ("card_id", _S), ("finish", _S), ("condition", _S),
    ("price", MONEY), ("quantity", _I), ("sold_at", _TS),
)

LISTING = _struct(
    ("event_id", _S), ("source", _S), ("card_id", _S), ("finish", _S), ("condition", _S),
    ("price", MONEY), ("quantity", _I), ("seller_id", _S), ("listed_at", _TS),
)

CARD_METADATA = _struct(
    ("card_id", _S), ("name", _S), ("set", _S), ("rarity", _S), ("game", _S), ("image_url", _S),
)

PRICE_WINDOW = _struct(
    ("market_key", _S), ("card_id", _S), ("window_type", _S), ("window_start", _TS),
    ("window_end", _TS), ("avg_price", MONEY), ("volatility", _D), ("volume", _L),
    ("sample_count", _L),
)

ALERT = _struct(
    ("alert_id", _S), ("type", _S), ("severity", _S), ("card_id", _S), ("market_key", _S),
    ("name", _S), ("detail", _S), ("ts", _TS),
)

MARKET_SNAPSHOT = _struct(
    ("market_key", _S), ("card_id", _S), ("finish", _S), ("condition", _S),
    ("last_price", MONEY), ("last_trade_at", _TS), ("avg_price", MONEY), ("volatility", _D),
    ("volume", _L), ("sample_count", _L),
)

#: Ticker sums carried from batch to batch.
RUNNING_STATE = _struct(
    ("market_key", _S), ("prior_count", _L), ("prior_sum", PRICE_SUM),
    ("prior_sq_sum", PRICE_SQ_SUM),
)


# Upstream page envelopes keep the feed's own field names.
PRODUCT_PAGE = _struct(
    ("items", T.ArrayType(_struct(("productId", _L), ("cardId", _S)))),
    ("page", _I), ("pageSize", _I), ("total", _I),
)

SET_PAGE = _struct(
    ("data", T.ArrayType(_struct(
        ("id", _S), ("name", _S), ("series", _S), ("printedTotal", _I), ("total", _I),
        ("releaseDate", _S), ("images", _struct(("symbol", _S), ("logo", _S))),
    ))),
)

CARD_PAGE = _struct(
    ("setId", _S),
    ("data", T.ArrayType(_struct(
        ("id", _S), ("name", _S), ("number", _S), ("rarity", _S), ("supertype", _S),
        ("types", T.ArrayType(_S)), ("images", _struct(("small", _S), ("large", _S))),
    ))),
)
