"""Spike and arbitrage detection against running ticker statistics."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions import keys, money
from marketpulse.operators.running import prior_stats
from marketpulse.schemas import Thresholds

# Severity ladders, first match wins.
SPIKE_LADDER = ((Decimal("5"), "HIGH"), (Decimal("4"), "MED"))
ARBITRAGE_LADDER = ((Decimal("0.40"), "HIGH"), (Decimal("0.25"), "MED"))
LOWEST = "LOW"

#: At equal times a sale counts before a listing is judged; then the event id decides.
TIE = ["kind_rank", "event_id"]
_COLUMNS = [
    "event_id", "source", "market_key", "card_id", "finish", "condition", "price", "quantity",
    "seller_id", "ts", "kind", "kind_rank", "counted",
]


def _prior() -> tuple[Column, Column, Column]:
    return F.col("prior_count"), F.col("prior_sum"), F.col("prior_sq_sum")


def _spread() -> Column:
    return money.scaled_variance(*_prior())


def _deviation() -> Column:
    n, total, _ = _prior()
    return money.scaled_deviation(F.col("price"), n, total)


def sale_events(sales: DataFrame) -> DataFrame:
    return _events(sales, "sale", 0, "sold_at", F.lit(None).cast("string"))


def listing_events(listings: DataFrame) -> DataFrame:
    return _events(listings, "listing", 1, "listed_at", F.col("seller_id"))


def market_events(sales: DataFrame | None, listings: DataFrame | None) -> DataFrame:
    """Sales and listings as one stream of events; either side may be missing."""
    if sales is None or listings is None:
        return listing_events(listings) if sales is None else sale_events(sales)
    return sale_events(sales).unionByName(listing_events(listings))


def with_scores(scored: DataFrame) -> DataFrame:
    """Mean, deviation and sigma ratio next to the running sums."""
    n, total, squares = _prior()
    spread, deviation = _spread(), _deviation()
    ratio = F.abs(deviation).cast("double") / F.sqrt(spread.cast("double"))
    return scored.withColumns(
        {
            "mean": money.mean_double(total, n),
            "stddev": money.stddev(n, total, squares),
            "sigma": F.when(spread > 0, ratio),
        }
    )


def is_spike(limits: Thresholds) -> Column:
    """A sale strictly more than ``spike_sigma`` deviations from its prior mean, up or down."""
    return (
        (F.col("kind") == "sale")
        & (F.col("prior_count") >= limits.min_samples)
        & (_spread() > 0)
        & money.at_least_sigmas(_deviation(), _spread(), limits.spike_sigma, strict=True)
    )


def is_arbitrage(limits: Thresholds) -> Column:
    """A listing strictly below the prior mean less the margin, compared without rounding."""
    n, total, _ = _prior()
    keep = F.lit(Decimal(1) - Decimal(limits.arbitrage_margin))
    cheap = F.col("price") * n.cast("decimal(13,0)") < total * keep
    return (F.col("kind") == "listing") & (n >= limits.min_samples) & (total > 0) & cheap


def spike_severity() -> Column:
    result = F.lit(LOWEST)
    for bound, name in reversed(SPIKE_LADDER):
        hit = money.at_least_sigmas(_deviation(), _spread(), bound)
        result = F.when(hit, F.lit(name)).otherwise(result)
    return result


def arbitrage_severity(discount: Column) -> Column:
    """From the discount already rounded to four digits."""
    result = F.lit(LOWEST)
    for bound, name in reversed(ARBITRAGE_LADDER):
        result = F.when(discount >= F.lit(float(bound)), F.lit(name)).otherwise(result)
    return result


def discount() -> Column:
    """Share of the prior mean a listing is below it, four digits half-up."""
    n, total, _ = _prior()
    gap = total - F.col("price") * n.cast("decimal(13,0)")
    return F.round(gap / total, 4).cast("double")


def spike_scores(sales: DataFrame) -> DataFrame:
    """Every sale with the statistics of all earlier sales of its ticker."""
    scored = prior_stats(sale_events(sales), TIE)
    return with_scores(scored)


def spike_events(sales: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    scored = prior_stats(sale_events(sales), TIE)
    return with_scores(scored.filter(is_spike(limits))).withColumn("severity", spike_severity())


def arbitrage_flags(
    sales: DataFrame,
    listings: DataFrame,
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """Listings below the running mean of their ticker as it stood when they were listed."""
    events = market_events(sales, listings)
    scored = prior_stats(events, TIE)
    return flag_view(scored.filter(is_arbitrage(limits)))


def flag_view(flagged: DataFrame) -> DataFrame:
    n, total, _ = _prior()
    return flagged.select(
        "event_id",
        "market_key",
        "card_id",
        "finish",
        "condition",
        "source",
        "seller_id",
        F.col("price").alias("listing_price"),
        money.mean_price(total, n).alias("reference_avg"),
        discount().alias("discount_pct"),
        n.alias("sample_count"),
        F.col("ts").alias("detected_at"),
    )


def market_alerts(
    sales: DataFrame | None,
    listings: DataFrame | None,
    limits: Thresholds = Thresholds(),
    carry: DataFrame | None = None,
) -> DataFrame:
    """Spike and arbitrage alerts from one pass over both feeds, not yet named."""
    events = market_events(sales, listings)
    scored = prior_stats(events, TIE, carry=carry)
    return alert_view(scored, limits)


def alert_view(scored: DataFrame, limits: Thresholds) -> DataFrame:
    """Alert rows of the scored events that meet a predicate."""
    n, total, _ = _prior()
    spike = F.col("kind") == "sale"
    hits = scored.filter(is_spike(limits) | is_arbitrage(limits))
    rows = with_scores(hits).withColumn("discount", discount())
    spike_detail = F.to_json(
        F.struct(
            F.col("price"),
            money.half_up(F.col("mean"), 4).alias("mean"),
            money.half_up(F.col("stddev"), 4).alias("stddev"),
            money.half_up(F.col("sigma"), 4).alias("sigma"),
            n.alias("sampleCount"),
        )
    )
    arbitrage_detail = F.to_json(
        F.struct(
            F.col("price").alias("listingPrice"),
            money.mean_price(total, n).alias("referenceAvg"),
            F.col("discount").alias("discountPct"),
            n.alias("sampleCount"),
            F.col("seller_id").alias("sellerId"),
        )
    )
    kind = F.when(spike, F.lit("SPIKE")).otherwise(F.lit("ARBITRAGE"))
    severity = F.when(spike, spike_severity()).otherwise(arbitrage_severity(F.col("discount")))
    return rows.select(
        keys.alert_id(kind, F.col("market_key"), F.col("event_id")).alias("alert_id"),
        kind.alias("type"),
        severity.alias("severity"),
        "card_id",
        "market_key",
        F.lit(None).cast("string").alias("name"),
        F.when(spike, spike_detail).otherwise(arbitrage_detail).alias("detail"),
        "ts",
        "event_id",
    )


def _events(df: DataFrame, kind: str, rank: int, ts: str, seller: Column) -> DataFrame:
    if "market_key" not in df.columns:
        df = df.withColumn("market_key", keys.market_key())
    return df.withColumns(
        {
            "seller_id": seller,
            "ts": F.col(ts),
            "kind": F.lit(kind),
            "kind_rank": F.lit(rank),
            "counted": F.lit(kind == "sale"),
        }
    ).select(*_COLUMNS)
