"""Ticker keys: ``card|FINISH|CONDITION``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketpulse.schemas import CONDITIONS, FINISHES


def market_key(card_id="card_id", finish="finish", condition="condition") -> Column:
    """Null when any part is null, so an incomplete event never gets a ticker."""
    sep = F.lit("|")
    return F.concat(F.col(card_id), sep, F.col(finish), sep, F.col(condition))


def parse_market_key(key: Column) -> Column:
    """Struct of the three parts plus ``valid``; the parts are null when invalid."""
    parts = F.split(key, r"\|", 3)
    finish, condition = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    valid = F.coalesce(
        (F.size(parts) == 3) & finish.isin(*FINISHES) & condition.isin(*CONDITIONS),
        F.lit(False),
    )
    return F.struct(
        F.when(valid, F.get(parts, F.lit(0))).alias("card_id"),
        F.when(valid, finish).alias("finish"),
        F.when(valid, condition).alias("condition"),
        valid.alias("valid"),
    )


def card_of(key: Column) -> Column:
    return F.split_part(key, F.lit("|"), F.lit(1))


def namespaced_id(source: Column, raw_id: Column) -> Column:
    """Null where the raw id is missing, so that such rows never share an id."""
    return F.concat(source, F.lit(":"), raw_id)


def alert_id(kind: Column, key: Column, event_id: Column) -> Column:
    """Derived from the triggering event, so a retried job writes the same id."""
    return F.sha2(F.concat_ws("|", kind, key, event_id), 256)


def valid_identifier(col: Column) -> Column:
    """Not blank, no ticker separator, no control character."""
    ok = col.rlike(r"(?U)\S") & ~F.contains(col, F.lit("|"))
    return F.coalesce(ok & ~col.rlike(r"[\x00-\x1F\x7F-\x9F]"), F.lit(False))


def enum_or_null(col: Column, members: tuple[str, ...]) -> Column:
    return F.when(col.isin(*members), col)


def ordinal(col: Column, members: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in members]), col)
