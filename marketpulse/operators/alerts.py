"""Alert enrichment, routing, counting, parsing and feed merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.schemas import ALERT_TYPES, SEVERITIES

_DETAIL = {
    "SPIKE": "price double, mean double, stddev double, sigma double, sampleCount bigint",
    "ARBITRAGE": (
        "listingPrice double, referenceAvg double, discountPct double, sampleCount bigint, "
        "sellerId string"
    ),
}


def enrich(alerts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Attach the card name; an alert of an unknown card keeps a null name."""
    names = metadata.select("card_id", F.col("name").alias("_name"))
    joined = alerts.join(names, "card_id", "left")
    return joined.withColumn("name", F.coalesce("_name", "name")).select(*alerts.columns)


def with_severity(alerts: DataFrame, severity: str) -> DataFrame:
    """One branch of the HIGH / MED / everything-else split."""
    if severity not in SEVERITIES:
        raise ValueError(f"unknown severity: {severity}")
    if severity == "LOW":
        return alerts.filter(~F.col("severity").isin("HIGH", "MED"))
    return alerts.filter(F.col("severity") == severity)


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("type", "severity").agg(F.count("*").alias("alerts"))


def spike_counts(alerts: DataFrame) -> DataFrame:
    spikes = alerts.filter(F.col("type") == "SPIKE")
    return spikes.groupBy("severity").agg(F.count("*").alias("spikes"))


def parse_detail(alerts: DataFrame, kind: str) -> DataFrame:
    """Alerts of one type with their detail as typed columns; corrupt detail fails the job."""
    if kind not in _DETAIL:
        raise ValueError(f"unknown alert type: {kind}")
    detail = F.from_json("detail", _DETAIL[kind], {"mode": "FAILFAST"})
    rows = alerts.filter(F.col("type") == kind).withColumn("_detail", detail)
    return rows.select(*[c for c in alerts.columns if c != "detail"], "_detail.*")


def with_variant_detail(alerts: DataFrame) -> DataFrame:
    """Alerts of all types with their detail as one VARIANT column, parsed once.

    A null detail stays null; text that is no JSON fails the job.
    """
    return alerts.withColumn("detail", F.parse_json("detail"))


def detail_field(*names: str, kind: str = "double") -> Column:
    """The first of the named members that a VARIANT detail has; null where it has none.

    A member that cannot be read as ``kind`` fails the job.
    """
    if not names:
        raise ValueError("name at least one member")
    found = [F.variant_get("detail", f"$.{name}", kind) for name in names]
    return reduce(lambda a, b: F.coalesce(a, b), found)


def recent(
    alerts: DataFrame, kind: str | None = None, severity: str | None = None, limit: int = 50
) -> DataFrame:
    """Newest alerts, optionally of one type or severity."""
    return _matching(alerts, kind, severity).orderBy(F.desc("ts"), "alert_id").limit(limit)


def merge_feed(
    live: DataFrame,
    stored: DataFrame,
    kind: str | None = None,
    severity: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Live and stored alerts without repeats: a live alert hides its stored copy."""
    older = stored.join(live.select("alert_id"), "alert_id", "left_anti")
    both = live.unionByName(older.select(*live.columns))
    return recent(both, kind, severity, limit)


def _matching(alerts: DataFrame, kind: str | None, severity: str | None) -> DataFrame:
    if kind is not None:
        if kind not in ALERT_TYPES:
            raise ValueError(f"unknown alert type: {kind}")
        alerts = alerts.filter(F.col("type") == kind)
    if severity is not None:
        if severity not in SEVERITIES:
            raise ValueError(f"unknown severity: {severity}")
        alerts = alerts.filter(F.col("severity") == severity)
    return alerts
