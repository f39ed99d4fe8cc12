"""Exact money arithmetic on decimal sums.

Sums stay DECIMAL until the last step, so a result does not depend on row order,
on partial aggregation or on how many tasks took part.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketpulse.schemas import MONEY, PRICE_SQ_SUM, PRICE_SUM

_COUNT = "decimal(13,0)"


def mean_price(price_sum: Column, n: Column) -> Column:
    """Two-digit half-up mean; zero for an empty group."""
    return F.when(n > 0, F.round(price_sum / n.cast(_COUNT), 2)).otherwise(F.lit(0)).cast(MONEY)


def mean_double(price_sum: Column, n: Column) -> Column:
    """Divided as decimals: a double quotient can miss a decimal tie by one bit."""
    return F.when(n > 0, (price_sum / n.cast(_COUNT)).cast("double")).otherwise(F.lit(0.0))


def scaled_variance(n: Column, price_sum: Column, price_sq_sum: Column) -> Column:
    """``n² · variance`` without rounding: ``n·Σp² − (Σp)²``."""
    total = price_sum.cast(PRICE_SUM)
    return n.cast(_COUNT) * price_sq_sum.cast(PRICE_SQ_SUM) - total * total


def stddev(n: Column, price_sum: Column, price_sq_sum: Column) -> Column:
    """Population standard deviation; zero below two samples."""
    spread = scaled_variance(n, price_sum, price_sq_sum).cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0))) / n).otherwise(F.lit(0.0))


def scaled_deviation(price: Column, n: Column, price_sum: Column) -> Column:
    """``n · (p − mean)`` without rounding."""
    return n.cast(_COUNT) * price - price_sum.cast(PRICE_SUM)


def at_least_sigmas(deviation: Column, spread: Column, sigmas: Decimal, strict=False) -> Column:
    """Compare ``|p − mean| / σ`` with a bound by squaring, free of float noise."""
    square = (Decimal(sigmas) ** 2).normalize()
    bound = spread * F.lit(Decimal(int(square)) if square == int(square) else square)
    return deviation * deviation > bound if strict else deviation * deviation >= bound


def half_up(value: Column, digits: int) -> Column:
    """Round a double half-up by its shortest decimal text (56.18725 → 56.1873)."""
    return F.round(value.cast("decimal(38,17)"), digits).cast("double")


def price_from_text(raw: Column) -> Column:
    """Parse feed text; null when it is not a number or cannot fit."""
    return F.trim(raw).try_cast("decimal(30,10)")


def text_scale(raw: Column) -> Column:
    """Digits after the point as written (``12.5000`` → 4), exponent included."""
    fraction = F.length(F.regexp_extract(raw, r"\.(\d+)", 1))
    exponent = F.regexp_extract(raw, r"[eE]\+?(-?\d{1,6})", 1)
    return fraction - F.when(exponent != "", exponent.cast("int")).otherwise(F.lit(0))
